"""Foreign keys the data implies: columns, alone or several together, whose values are
found in a key elsewhere."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from itertools import combinations
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from ..functions.sqltext import quote_column
from ..functions.typing import (
    BYTES,
    INTEGER,
    NUMERIC,
    STRING,
    TIME_KINDS,
    field_type,
    is_id_name,
    kind_of,
)
from ..session import local_frame
from ..sources.tables import Tables

_BITS = 63  # columns per bigint
_SKETCH_BITS = 32_768  # of Spark's bitmaps
_KEY_KINDS = frozenset({INTEGER, STRING, BYTES, *TIME_KINDS})

#: One or several columns of a table.
Side = tuple[str, tuple[str, ...]]


def not_a_key(tables: Tables, column: tuple[str, str]) -> str | None:
    """Why a column cannot be a key, if so."""
    try:
        _key_kind(*column, field_type(tables(column[0]).schema, column[1]))
    except Exception as e:  # no such table or column, or a type without exact values
        return str(e)
    return None


def _key_kind(table: str, name: str, data_type: T.DataType) -> str:
    """A kind whose values mean the same after a cast to string."""
    kind = kind_of(data_type)
    if kind == NUMERIC and data_type.scale == 0:
        kind = INTEGER
    if kind not in _KEY_KINDS:
        raise ValueError(f"{table}.{name} of type {data_type.simpleString()} cannot be a key")
    return kind


def _value(df: DataFrame, names: tuple[str, ...], value_type: str) -> Column:
    """What is compared: NULL unless all columns have a value."""

    def cast(name: str) -> Column:
        column = F.col(quote_column(name, df.schema))
        if kind_of(field_type(df.schema, name)) == BYTES:
            column = F.hex(column)  # bytes are no text
        return column.cast("bigint" if value_type == "bigint" else "string")

    values = [cast(name) for name in names]
    if value_type != "array<string>":
        return values[0]
    filled = reduce(lambda a, b: a & b, (v.isNotNull() for v in values))
    return F.when(filled, F.array(*values))


def _cells(
    df: DataFrame, sides: dict[int, tuple[str, ...]], words: int, value_type: str
) -> DataFrame:
    """(value, w0, w1, ...) of several sides of one table, from one scan.

    The words are a bit set with the side's own bit on.
    """

    def cell(side: int, names: tuple[str, ...]):
        bits = [1 << side % _BITS if w == side // _BITS else 0 for w in range(words)]
        return F.struct(
            _value(df, names, value_type).alias("value"),
            *(F.lit(b).cast("long").alias(f"w{w}") for w, b in enumerate(bits)),
        )

    cells = F.array(*(cell(i, names) for i, names in sides.items()))
    return df.select(F.inline(cells)).where("value IS NOT NULL")


def _filled(df: DataFrame, sides: dict[int, tuple[str, ...]], value_type: str) -> DataFrame:
    """(column_id, n_values): how many rows of each side are not NULL."""
    counts = df.agg(*(F.count(_value(df, c, value_type)).alias(f"n{i}") for i, c in sides.items()))
    pairs = (F.struct(F.lit(i).alias("column_id"), F.col(f"n{i}").alias("n_values")) for i in sides)
    return counts.select(F.inline(F.array(*pairs)))


class _Sketch(NamedTuple):
    """Bounds of a side's values, and a bit for each hash that some value has."""

    low: object
    high: object
    hashes: int | None = None

    def may_share(self, other: _Sketch) -> bool:
        """False only where the two have no value in common for certain."""
        if self.low is None or other.low is None:
            return False
        apart = self.high < other.low or other.high < self.low
        return not apart and (self.hashes is None or bool(self.hashes & other.hashes))


def _sketches(
    frames: dict[str, DataFrame],
    sides: dict[str, dict[int, tuple[str, ...]]],
    value_type: str,
    bitmaps: bool,
) -> dict[int, _Sketch]:
    """One aggregate a table; what comes back is the bounds of each side, and 4 KB with
    `bitmaps`."""
    parts = []
    for table, own in sides.items():
        df = frames[table]
        values = {i: _value(df, names, value_type) for i, names in own.items()}
        place = {i: F.pmod(F.xxhash64(v), F.lit(_SKETCH_BITS)) for i, v in values.items()}
        found = df.agg(
            *(f(v).alias(f"{n}{i}") for i, v in values.items() for n, f in (("low", F.min), ("high", F.max))),
            *(
                F.bitmap_construct_agg(
                    F.when(v.isNotNull(), F.bitmap_bit_position(place[i]))
                ).alias(f"bits{i}")
                for i, v in values.items()
                if bitmaps
            ),
        )
        names = ("low", "high", "bits") if bitmaps else ("low", "high")
        cells = F.array(
            *(F.struct(F.lit(i).alias("side"), *(F.col(f"{n}{i}").alias(n) for n in names)) for i in own)
        )
        parts.append(found.select(F.inline(cells)))
    rows = reduce(DataFrame.unionByName, parts).collect()
    return {
        r["side"]: _Sketch(r["low"], r["high"], int.from_bytes(r["bits"], "big") if bitmaps else None)
        for r in rows
    }


_COLUMNS = (
    "child_table string, child_column string, parent_table string, parent_column string,"
    " distinct_values long, matched long, coverage double, parent_is_unique boolean"
)


def _inclusions(
    spark: SparkSession,
    tables: Tables,
    pairs: list[tuple[Side, Side]],
    parents: set[Side],
    value_type: str,
    prune: str,
) -> DataFrame:
    """The pairs that share values, all compared in one shuffle.

    A cell is its value and a bit set of one side; equal values are merged by OR, so a
    value ends as one row saying which sides hold it, however often it is repeated. The
    bit sets that occur are few; only they, with the number of values behind each, are
    matched with pairs. No side is joined with another. Sides that share no value with
    any other for certain, as far as `prune` tells, are not read for it.
    """
    if prune not in ("none", "bounds", "sketches"):
        raise ValueError(f"prune must be 'none', 'bounds' or 'sketches', not {prune!r}")
    wanted = list(dict.fromkeys(side for pair in pairs for side in pair))
    frames = {table: tables(table) for table in dict.fromkeys(table for table, _ in wanted)}

    def numbered() -> dict[str, dict[int, tuple[str, ...]]]:
        order = sorted(wanted, key=lambda side: side[0])
        out: dict[str, dict[int, tuple[str, ...]]] = {}
        for i, (table, names) in enumerate(order):
            out.setdefault(table, {})[i] = names
        return out

    def ids_of(sides: dict[str, dict[int, tuple[str, ...]]]) -> dict[Side, int]:
        return {(table, names): i for table, own in sides.items() for i, names in own.items()}

    sides = numbered()
    if prune != "none" and wanted:
        found, ids = _sketches(frames, sides, value_type, prune == "sketches"), ids_of(sides)
        pairs = [(c, p) for c, p in pairs if found[ids[c]].may_share(found[ids[p]])]
        wanted = list(dict.fromkeys(side for pair in pairs for side in pair))
        sides = numbered()
    if not wanted:
        return local_frame(spark, [], _COLUMNS)
    ids = ids_of(sides)
    words = len(wanted) // _BITS + 1
    cells, filled = [], []
    for table, own in sides.items():
        cells.append(_cells(frames[table], own, words, value_type))
        keys = {i: names for i, names in own.items() if (table, names) in parents}
        if keys:
            filled.append(_filled(frames[table], keys, value_type))

    # A side paired with itself gives its number of distinct values.
    listed = [(c, c) for c in ids] + [(c, p) for c, p in pairs]
    pair = local_frame(
        cells[0].sparkSession,
        [(c[0], ",".join(c[1]), p[0], ",".join(p[1]), ids[c], ids[p]) for c, p in listed],
        "child_table string, child_column string, parent_table string, parent_column string,"
        " child_id int, parent_id int",
    )
    names = [f"w{w}" for w in range(words)]
    holders = (
        reduce(DataFrame.unionByName, cells)
        .groupBy("value")
        .agg(*(F.bit_or(w).alias(w) for w in names))
        .groupBy(*names)
        .agg(F.count(F.lit(1)).alias("n"))
    )

    def columns_in(word: int) -> Column:
        bits = F.sequence(F.lit(0), F.lit(_BITS - 1))
        on = F.filter(bits, lambda bit: F.getbit(names[word], bit) == 1)
        return F.transform(on, lambda bit: bit + word * _BITS)

    held = F.concat(*(columns_in(word) for word in range(words)))
    counts = (
        holders.select("n", held.alias("held"))
        .select("n", "held", F.explode("held").alias("child_id"))
        .join(F.broadcast(pair), "child_id")  # at most as many rows as sides squared
        .where(F.array_contains("held", F.col("parent_id")))
        .groupBy(*pair.columns)
        .agg(F.sum("n").alias("matched"))
        .join(
            F.broadcast(reduce(DataFrame.unionByName, filled)),  # one row for each parent
            F.col("parent_id") == F.col("column_id"),
            "left",
        )
    )
    itself = F.col("child_id") == F.col("parent_id")
    of_child, of_parent = W.partitionBy("child_id"), W.partitionBy("parent_id")
    own = F.when(itself, F.col("matched"))
    return (
        counts.withColumn("distinct_values", F.max(own).over(of_child))
        .withColumn("parent_is_unique", F.max(own).over(of_parent) == F.col("n_values"))
        .where(~itself)
        .select(
            "child_table", "child_column", "parent_table", "parent_column", "distinct_values",
            "matched", (F.col("matched") / F.col("distinct_values")).alias("coverage"),
            "parent_is_unique",
        )
    )


def _comparable(
    tables: Tables, children: list[tuple[str, str]], parents: list[tuple[str, str]]
) -> tuple[list[tuple[Side, Side]], str]:
    """Pairs of columns that may be compared, and the type their values are compared as."""
    frames = {table: tables(table) for table, _ in children + parents}
    types = {(t, c): field_type(frames[t].schema, c) for t, c in children + parents}
    kinds = {column: _key_kind(*column, data_type) for column, data_type in types.items()}

    def compare(child, parent) -> bool:
        by_id = is_id_name(child[1]) or is_id_name(parent[1])
        return kinds[child] == kinds[parent] or by_id

    pairs = [
        ((c[0], (c[1],)), (p[0], (p[1],)))
        for c in children for p in parents if c != p and compare(c, p)
    ]
    # Integers stay integers unless text has to be compared with them.
    only_integers = {kind_of(data_type) for data_type in types.values()} == {INTEGER}
    return list(dict.fromkeys(pairs)), "bigint" if only_integers else "string"


def implied_foreign_keys(
    tables: Tables,
    children: Iterable[tuple[str, str]],
    parents: Iterable[tuple[str, str]],
    min_coverage: float = 0.0,
    prune: str = "bounds",
) -> DataFrame:
    """(child_table, child_column, parent_table, parent_column, distinct_values, matched,
    coverage, parent_is_unique) for pairs of columns that share at least one value.

    prune: a first pass over the columns keeps their "bounds", or with "sketches" also a
    bitmap of their values' hashes, which takes longer; columns that share no value with
    any other for certain are left out of the shuffle. The rows are the same with "none".
    """
    children, parents = list(children), list(parents)
    pairs, value_type = _comparable(tables, children, parents)
    keys = {(table, (column,)) for table, column in parents}
    spark = tables((children + parents)[0][0]).sparkSession
    found = _inclusions(spark, tables, pairs, keys, value_type, prune)
    return found.where(F.col("coverage") >= min_coverage)


def implied_composite_keys(
    tables: Tables,
    children: Iterable[tuple[str, str]],
    parents: Iterable[tuple[str, str]],
    min_coverage: float = 0.0,
    size: int = 2,
    prune: str = "bounds",
) -> DataFrame:
    """The same for sets of 2 to `size` columns of a table; the columns' names are listed
    with commas, a child's in the order of their names.

    Tuples can only share a value where each of their columns does, so a level's
    candidates are made of the pairs found the level before, and each level is compared
    in one shuffle. Rows with a NULL in one of the columns do not count.
    """
    children, parents = list(children), list(parents)
    singles, value_type = _comparable(tables, children, parents)
    keys = {side for _, side in singles}
    spark = tables((children + parents)[0][0]).sparkSession
    shared = {
        ((r.child_table, (r.child_column,)), (r.parent_table, (r.parent_column,)))
        for r in _inclusions(spark, tables, singles, keys, value_type, prune).collect()  # pairs of columns
    }
    single, out = shared, None
    for level in range(2, size + 1):
        candidates = _joined(shared, single, level)
        if not candidates:
            break
        keys = {side for _, side in candidates}
        found = _inclusions(spark, tables, candidates, keys, "array<string>", prune)
        out = found if out is None else out.unionByName(found)
        shared = {
            ((r.child_table, tuple(r.child_column.split(","))), (r.parent_table, tuple(r.parent_column.split(","))))
            for r in (found.collect() if level < size else [])
        }
    if out is None:
        return local_frame(spark, [], _COLUMNS)
    return out.where(F.col("coverage") >= min_coverage)


def _joined(
    shared: set[tuple[Side, Side]], single: set[tuple[Side, Side]], level: int
) -> list[tuple[Side, Side]]:
    """Pairs of tuples one longer than those shared, all of whose parts are shared."""
    out = set()
    for (table, names), (parent, keys) in shared:
        for (other, (name,)), (other_parent, (key,)) in single:
            if (other, other_parent) != (table, parent) or name <= names[-1] or key in keys:
                continue
            columns = [*zip(names, keys, strict=True), (name, key)]
            parts = (tuple(zip(*part, strict=True)) for part in combinations(columns, level - 1))
            if all(((table, c), (parent, k)) in shared for c, k in parts):
                out.add(((table, (*names, name)), (parent, (*keys, key))))
    return sorted(out)
