"""Keys and dependencies a table's rows obey, found level by level.

Both are questions about the partition of the rows by a set of columns: the set is a key
if every part is one row, and it determines another column if that column is constant in
every part. A level of the lattice of sets, all those of one size that are not decided
yet, is grouped at once. Sets that share a column whose values all have few rows have it
as their home: the rows are dealt out by it once, and the parts of all those sets are made
where the rows then are. So what is shuffled does not grow with the number of sets. Sets
without such a column have parts of many rows, which shrink before their shuffle; they are
one aggregate over grouping sets. Single columns are counted first, by their values alone.

What can be ruled out is not grouped:

* a set with a subset that is a key, or that determines the column, is not minimal;
* a set has at most as many parts as the product of its columns' distinct values. With
  fewer parts than rows it is no key, and with fewer parts than the column has values (and
  violating rows are allowed for) it does not determine it;
* two rows of a bounded sample that agree in the set are proof against a key, and against
  a dependency if they differ in the column;
* so are two rows of a slice, all rows whose home has a hash in a fixed share of all: it has
  whole parts, so what violates there is not fewer than it looks.

Parts with a home, and single columns, are told apart by two 64-bit hashes, like text.

Which sets are looked at is settled on the driver, by their number of columns; rows and
groups never come there.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.sqltext import quote_part
from ..functions.typing import BYTES, FLOAT, NESTED_KINDS, STRING, kind_of
from ..session import local_frame, written

#: Rows of the sample that rules sets out.
SAMPLE_ROWS = 20_000
#: Sets grouped in one aggregate; a level of more takes several.
SETS_AT_ONCE = 48
#: Rows of a task that has the rows of some homes; a value with more makes its column none.
TASK_ROWS = 50_000
#: A slice is one of so many parts of the hashes; tables below that many rows have none.
SLICES, SLICED_FROM = 16, 200_000

Set = tuple[str, ...]


class _Table:
    """The columns that can be compared, as numbers or text: NULL is a value like any
    other, and -0.0 is 0.0."""

    def __init__(self, df: DataFrame, columns: Iterable[str] | None):
        fields = {f.name: f for f in df.schema.fields}
        names = list(columns or (n for n, f in fields.items() if kind_of(f.dataType) not in NESTED_KINDS))
        kinds = {n: kind_of(fields[n].dataType) for n in names}
        nested = [n for n in names if kinds[n] in NESTED_KINDS]
        if nested:
            raise ValueError(f"columns {', '.join(nested)} cannot be compared")
        self.names = names
        self.text = {n for n in names if kinds[n] in (STRING, BYTES)}
        # of these one hash is not enough to tell values apart
        self.long = self.text | {n for n in names if getattr(fields[n].dataType, "precision", 0) > 18}

        def value(name: str) -> Column:
            column = F.col(quote_part(name))
            return (column + F.lit(0.0) if kinds[name] == FLOAT else column).alias(self.own(name))

        self.rows = df.select(*(value(n) for n in names))

    def own(self, name: str) -> str:
        return f"c{self.names.index(name)}"

    def constant(self, name: str) -> Column:
        """Whether a column has one value in a group. Text is compared by two hashes, so
        that the aggregate is compiled."""
        c = F.col(self.own(name))
        if name in self.text:
            one = F.min(F.xxhash64(c)) == F.max(F.xxhash64(c))
            same = one & (F.min(F.xxhash64(F.lit(1), c)) == F.max(F.xxhash64(F.lit(1), c)))
        else:
            same = F.coalesce(F.min(c) == F.max(c), F.lit(True))
        return (F.count(c) == 0) | ((F.count(c) == F.count("*")) & same)

    def identity(self, columns: Set) -> list[Column]:
        """Two hashes that rows share if they agree in the columns. NULL leaves a hash as
        it is, so where it is counts as well."""
        values = [x for c in columns for x in (F.col(self.own(c)), F.col(self.own(c)).isNull())]
        return [F.xxhash64(*values).alias("h1"), F.xxhash64(F.lit(1), *values).alias("h2")]

    def hashes(self, name: str) -> dict[str, Column]:
        """What `constant_hash` compares: NULL, or one hash of a number and two of text."""
        c, at = F.col(self.own(name)), self.own(name)
        found = {f"{at}_a": F.xxhash64(c)}
        if name in self.long:
            found[f"{at}_b"] = F.xxhash64(F.lit(1), c)
        return {k: F.when(c.isNotNull(), v) for k, v in found.items()}

    def constant_hash(self, name: str) -> Column:
        """`constant` of rows that carry the column's hashes."""
        a, *b = (F.col(k) for k in self.hashes(name))
        same = F.min(a) == F.max(a)
        for more in b:
            same = same & (F.min(more) == F.max(more))
        return (F.count(a) == 0) | ((F.count(a) == F.count("*")) & F.coalesce(same, F.lit(True)))


def _numbered(table: _Table, sets: list[Set]) -> Column:
    """A row for each set: its number and the row's identity in it."""
    return F.inline(F.array(*(F.struct(F.lit(k).alias("set"), *table.identity(s)) for k, s in enumerate(sets))))


def _counted(table: _Table, names: list[str]) -> dict[str, tuple[int, int, int]]:
    """For each column its values, the rows of values with several rows, and the most rows
    of a value; nothing but hashes of values and their numbers is shuffled."""
    sets = [(c,) for c in names]
    parts = table.rows.select(_numbered(table, sets)).groupBy("set", "h1", "h2").agg(F.count("*").alias("n"))
    found = (
        parts.groupBy("set")
        .agg(
            F.count("*").alias("parts"),
            F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("repeated"),
            F.max("n").alias("most"),
        )
        .collect()  # one row for each column
    )
    return {names[r["set"]]: (r["parts"], r["repeated"], r["most"]) for r in found}


def _at_home(
    table: _Table, home: str, wanted: dict[Set, set[str]], rows: int, slices: int = 1
) -> dict[Set, tuple]:
    """What `_grouped` returns for sets that hold the column `home`, of all rows or of one
    slice, from one shuffle of the columns that are used."""
    out = {}
    order = sorted(wanted, key=lambda s: [table.names.index(c) for c in s])
    column = table.own(home)
    used = {c for s in order for c in s} | {c for s in order for c in wanted[s]}
    dealt = table.rows.select(*(table.own(c) for c in table.names if c in used))
    if slices > 1:
        dealt = dealt.where(F.pmod(F.xxhash64(column), F.lit(slices)) == 0)
    dealt = dealt.repartition(max(1, math.ceil(rows / slices / TASK_ROWS)), F.col(column))
    for at in range(0, len(order), SETS_AT_ONCE):
        sets = order[at : at + SETS_AT_ONCE]
        others = sorted({c for s in sets for c in wanted[s]}, key=table.names.index)
        hashes = {k: v for c in others for k, v in table.hashes(c).items()}
        parts = (
            dealt.select(column, *(v.alias(k) for k, v in hashes.items()), _numbered(table, sets))
            .groupBy(column, "set", "h1", "h2")
            .agg(F.count("*").alias("n"), *(table.constant_hash(c).alias(f"same{k}") for k, c in enumerate(others)))
        )
        for row in _sums(parts, "set", len(others)):
            bad = {c: row[f"bad{k}"] for k, c in enumerate(others)}
            out[sets[row["set"]]] = (row["parts"], row["repeated"], bad)
    none = {s: (0, 0, dict.fromkeys(wanted[s], 0)) for s in order}
    return {**none, **out}


def _sums(parts: DataFrame, by: str, others: int) -> list:
    """For each set its parts, the rows in parts of several rows and those in parts where
    a column is not constant; one row for each set."""
    return (
        parts.groupBy(by)
        .agg(
            F.count("*").alias("parts"),
            F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("repeated"),
            *(
                F.coalesce(F.sum(F.when(~F.col(f"same{k}"), F.col("n"))), F.lit(0)).alias(f"bad{k}")
                for k in range(others)
            ),
        )
        .collect()
    )


def _grouped(table: _Table, rows: DataFrame, wanted: dict[Set, set[str]]) -> dict[Set, tuple]:
    """For each set: its parts, the rows in parts of several rows, and for each column
    wanted the rows in parts where it is not constant."""
    out = {}
    order = sorted(wanted, key=lambda s: [table.names.index(c) for c in s])
    for at in range(0, len(order), SETS_AT_ONCE):
        sets = order[at : at + SETS_AT_ONCE]
        used = sorted({c for s in sets for c in s}, key=table.names.index)
        others = sorted({c for s in sets for c in wanted[s]}, key=table.names.index)
        columns = [F.col(table.own(c)) for c in used]
        parts = rows.groupingSets([[F.col(table.own(c)) for c in s] for s in sets], *columns).agg(
            F.grouping_id(*columns).alias("id"),
            F.count("*").alias("n"),
            *(table.constant(c).alias(f"same{k}") for k, c in enumerate(others)),
        )
        sums = _sums(parts, "id", len(others))
        ids = {sum(1 << (len(used) - 1 - k) for k, c in enumerate(used) if c not in s): s for s in sets}
        for row in sums:
            bad = {c: row[f"bad{k}"] for k, c in enumerate(others)}
            out[ids[row["id"]]] = (row["parts"], row["repeated"], bad)
    return out


def _sampled(rows: DataFrame) -> DataFrame:
    """The rows with the smallest hashes; equal rows all come or none, so repeated rows
    may make the sample smaller."""
    hashed = rows.withColumn("hash", F.xxhash64(*rows.columns))
    last = hashed.select("hash").orderBy("hash").limit(SAMPLE_ROWS).agg(F.max("hash")).first()[0]
    below = hashed.where(F.col("hash") < F.lit(last)) if last is not None else hashed.limit(0)
    return written(below.drop("hash"), "sample")


class _Search:
    def __init__(self, table: _Table, size: int, error: float):
        self.table, self.size, self.error = table, size, error
        self.n = table.rows.count()
        self.sample = _sampled(table.rows)
        self.sampled = self.sample.count()
        self.distinct: dict[str, int] = {}
        self.most: dict[str, int] = {}
        self.keys: list[Set] = []
        self.determined: dict[str, list[Set]] = {c: [] for c in table.names}
        self.errors: dict[tuple[Set, str], int] = {}
        self.grouped_sets = 0

    def allowed(self) -> int:
        return math.floor(self.error * self.n)

    def sample_limit(self) -> float:
        """More violating rows than this in the sample are proof that more than the
        allowed share of all rows violate; with a share above 0, up to a chance of 1e-12."""
        mean = self.error * self.sampled
        return mean + 8 * math.sqrt(mean) + (16 if mean else 0)

    def most_parts(self, columns: Set) -> int:
        return math.prod(self.distinct.get(c, self.n) for c in columns)

    def candidates(self, size: int, dependencies: bool) -> tuple[set[Set], dict[Set, set[str]]]:
        """Sets that may be keys, and for each set the columns it may determine."""
        keys, dependents = set(), {}
        for columns in combinations(self.table.names, size):
            own = set(columns)
            if any(set(k) <= own for k in self.keys):
                continue
            if self.most_parts(columns) >= self.n:
                keys.add(columns)
            if not dependencies:
                continue
            for c in self.table.names:
                known = any(set(d) <= own for d in self.determined[c])
                few = self.most_parts(columns) + self.allowed() < self.distinct.get(c, 0)
                if c not in own and not known and not few:
                    dependents.setdefault(columns, set()).add(c)
        return keys, dependents

    def refuted(self, keys: set[Set], dependents: dict[Set, set[str]]) -> None:
        """Takes away what the sample proves wrong."""
        wanted = {s: dependents.get(s, set()) for s in keys | dependents.keys()}
        for columns, (_, repeated, bad) in _grouped(self.table, self.sample, wanted).items():
            if repeated:
                keys.discard(columns)
            left = {c for c in dependents.get(columns, ()) if bad[c] <= self.sample_limit()}
            if left:
                dependents[columns] = left
            else:
                dependents.pop(columns, None)

    def homes(self, sets: Iterable[Set]) -> dict[str | None, list[Set]]:
        """The sets by their home, the column with the most values of those whose values
        have few rows each; None where all have a value with many."""
        out: dict[str | None, list[Set]] = {}
        for columns in sets:
            able = [c for c in columns if self.most[c] <= TASK_ROWS]
            home = max(able, key=lambda c: (self.distinct[c], c), default=None)
            out.setdefault(home, []).append(columns)
        return out

    def sliced(self, keys: set[Set], dependents: dict[Set, set[str]]) -> None:
        """Takes away what violates more than is allowed in one slice of the rows."""
        for home, sets in self.homes(keys | dependents.keys()).items():
            if home is None:
                continue
            wanted = {s: dependents.get(s, set()) for s in sets}
            for columns, (_, repeated, bad) in _at_home(self.table, home, wanted, self.n, SLICES).items():
                if repeated:
                    keys.discard(columns)
                left = {c for c in dependents.get(columns, ()) if bad[c] <= self.allowed()}
                if left:
                    dependents[columns] = left
                else:
                    dependents.pop(columns, None)

    def grouped(self, wanted: dict[Set, set[str]]) -> dict[Set, tuple]:
        out = {}
        for home, sets in self.homes(wanted).items():
            own = {s: wanted[s] for s in sets}
            if home is None:
                out |= _grouped(self.table, self.table.rows, own)
            else:
                out |= _at_home(self.table, home, own, self.n)
        return out

    def run(self, dependencies: bool) -> _Search:
        for c, (parts, repeated, most) in _counted(self.table, self.table.names).items():
            self.distinct[c], self.most[c] = parts, most
            if not repeated:
                self.keys.append((c,))
        for size in range(1, self.size + 1):
            keys, dependents = self.candidates(size, dependencies)
            if size == 1:
                keys = set()
            if self.sampled and self.n > self.sampled:
                self.refuted(keys, dependents)
            # with errors allowed a slice hardly ever proves anything
            if self.n >= SLICED_FROM and not self.allowed():
                self.sliced(keys, dependents)
            wanted = {s: dependents.get(s, set()) for s in keys | dependents.keys()}
            self.grouped_sets += len(wanted)
            for columns, (_, repeated, bad) in self.grouped(wanted).items():
                if columns in keys and not repeated:
                    self.keys.append(columns)
                for c in dependents.get(columns, ()):
                    if bad[c] <= self.allowed():
                        self.determined[c].append(columns)
                        self.errors[columns, c] = bad[c]
        return self


def repeated_values(df: DataFrame, columns: Iterable[str]) -> dict[str, int]:
    """For each column how many of its values several rows have, NULL being a value; all
    columns are grouped in one shuffle."""
    columns = list(dict.fromkeys(columns))
    out: dict[str, int] = {}
    for at in range(0, len(columns), SETS_AT_ONCE):
        table = _Table(df, columns[at : at + SETS_AT_ONCE])
        own = [F.col(table.own(c)) for c in table.names]
        groups = table.rows.groupingSets([[c] for c in own], *own).agg(
            F.grouping_id(*own).alias("id"), F.count("*").alias("n")
        )
        counts = groups.groupBy("id").agg(F.count_if(F.col("n") > 1).alias("n")).collect()
        found = {row["id"]: row["n"] for row in counts}
        everything = (1 << len(own)) - 1
        for k, c in enumerate(table.names):
            out[c] = found.get(everything ^ (1 << (len(own) - 1 - k)), 0)
    return out


def minimal_keys(df: DataFrame, columns: Iterable[str] | None = None, size: int = 3) -> DataFrame:
    """key_columns (an array) and size of every smallest set of up to `size` columns that
    no two rows agree in.

    NULLs are equal to each other, as in the check for duplicate keys. A table without
    rows, or with repeated rows, has none. `columns` defaults to all that are not nested.
    """
    table = _Table(df, columns)
    found = _Search(table, size, 0.0).run(dependencies=False) if table.rows.limit(1).count() else None
    rows = [(list(k), len(k)) for k in (found.keys if found else [])]
    return local_frame(df.sparkSession, rows, "key_columns array<string>, size int")


def dependencies(
    df: DataFrame, columns: Iterable[str] | None = None, size: int = 2, error: float = 0.0
) -> DataFrame:
    """determinant (an array of columns), dependent and violating_rows of every smallest
    set of up to `size` columns that determines another column.

    violating_rows counts the rows that share their values of the determinant with a row
    of another dependent value, and is at most `error` of all rows. A set with a smaller
    one in it that determines the column is left out, and so is one with a key in it,
    which determines all. NULL is a value like any other. A constant column is determined
    by every other.
    """
    table = _Table(df, columns)
    found = None
    if table.rows.limit(1).count():
        found = _Search(table, size, error).run(dependencies=True)
    keys = set(found.keys) if found else set()
    rows = [
        (list(s), c, bad) for (s, c), bad in (found.errors.items() if found else []) if s not in keys
    ]
    return local_frame(
        df.sparkSession, rows, "determinant array<string>, dependent string, violating_rows long"
    )
