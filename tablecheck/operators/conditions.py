"""Conditions between columns that (nearly) all rows obey, from evidence sets.

An item is a pair of comparable columns, or a number column and zero. In a row an item is
in one of three states, less, equal or greater, or is not known because of a NULL. The
states of all items of a row are its evidence, packed two bits an item; rows with the same
evidence are counted, in one aggregate whose rows are few however many the table has.
Which conditions hold, alone or where another one does, and how many rows violate them,
is read off the evidence, so the counts are those of all rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.sqltext import quote_part
from ..functions.typing import BOOLEAN, FLOAT, NUMBER_KINDS, STRING, TIME_KINDS, kind_of
from ..session import local_frame, written

SCHEMA = "condition string, columns string, only_where string, rows_checked long, violating_rows long, violation string"
_LESS, _EQUAL, _GREATER, _UNKNOWN = 1, 2, 3, 0
#: Conditions by the states they allow, strong before weak.
_OPERATORS = {
    "=": {_EQUAL}, "<": {_LESS}, ">": {_GREATER},
    "<=": {_LESS, _EQUAL}, ">=": {_GREATER, _EQUAL}, "<>": {_LESS, _GREATER},
}
_ITEMS_PER_WORD = 31


class Item(NamedTuple):
    left: str
    right: str  # a column or 0, as SQL text
    ordered: bool
    columns: str

    def condition(self, operator: str) -> str:
        return f"{self.left} {operator} {self.right}"


def items_of(df: DataFrame, columns: Iterable[str] | None = None) -> list[Item]:
    """Numbers with zero, and columns of one family with each other. Text and truth values
    are compared for equality only."""
    kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields}
    names = list(columns or kinds)
    families = {**{k: "number" for k in NUMBER_KINDS}, **{k: k for k in (*TIME_KINDS, STRING, BOOLEAN)}}
    found = [Item(quote_part(c), "0", True, c) for c in names if kinds[c] in NUMBER_KINDS]
    for a, b in combinations(names, 2):
        if kinds[a] in families and families[kinds[a]] == families.get(kinds[b]):
            ordered = kinds[a] not in (STRING, BOOLEAN)
            found.append(Item(quote_part(a), quote_part(b), ordered, f"{a},{b}"))
    return found


def _without_nan(df: DataFrame) -> DataFrame:
    """NaN is neither less nor greater than anything, so it is not known."""
    numbers = [f.name for f in df.schema.fields if kind_of(f.dataType) == FLOAT]
    return df.withColumns({c: F.nanvl(F.col(quote_part(c)), F.lit(None)) for c in numbers})


def evidence(df: DataFrame, items: list[Item]) -> DataFrame:
    """w0, w1, ... and n: how many rows have each evidence."""

    def state(item: Item) -> Column:
        text = (
            f"CASE WHEN {item.left} < {item.right} THEN {_LESS} WHEN {item.left} = {item.right}"
            f" THEN {_EQUAL} WHEN {item.left} > {item.right} THEN {_GREATER} ELSE {_UNKNOWN} END"
        )
        return F.expr(f"CAST({text} AS BIGINT)")

    words: dict[str, Column] = {}
    for at, item in enumerate(items):
        name = f"w{at // _ITEMS_PER_WORD}"
        shifted = F.shiftleft(state(item), 2 * (at % _ITEMS_PER_WORD))
        words[name] = words[name].bitwiseOR(shifted) if name in words else shifted
    rows = _without_nan(df).select(*(w.alias(name) for name, w in words.items()))
    return rows.groupBy(*words).agg(F.count("*").alias("n"))


def _states(found: DataFrame, items: int) -> DataFrame:
    """n and cells, the (item, state) pairs, of each evidence."""
    cells = F.array(
        *(
            F.struct(
                F.lit(i).alias("item"),
                F.shiftright(f"w{i // _ITEMS_PER_WORD}", 2 * (i % _ITEMS_PER_WORD))
                .bitwiseAND(F.lit(3)).cast("int").alias("state"),
            )
            for i in range(items)
        )
    )
    return found.select("n", cells.alias("cells"))


def _allowed(item: Item, counts: dict[int, int], error: float) -> tuple[str, int] | None:
    """The strongest operator that at most the share `error` of the rows violates."""
    total = sum(counts.values())
    for operator, states in _OPERATORS.items():
        bad = sum(n for state, n in counts.items() if state not in states)
        fits = item.ordered or operator == "="
        if fits and total and bad <= error * total and bad < total:
            return operator, bad
    return None


def conditions(
    df: DataFrame,
    columns: Iterable[str] | None = None,
    error: float = 0.0,
    implied: bool = False,
    min_support: float = 0.05,
) -> DataFrame:
    """condition, columns, only_where, rows_checked, violating_rows and violation (the SQL predicate
    of the violating rows) of the strongest condition each item obeys in all rows but the
    share `error`.

    Rows with a NULL or NaN in an item are not checked by it. implied: also conditions
    that hold only in the rows of one state of another item (`only_where`), which at least
    the share `min_support` of all rows are; what holds in all rows is not repeated. An
    empty table has no conditions.
    """
    items = items_of(df, columns)
    if not items:
        return local_frame(df.sparkSession, [], SCHEMA)
    found = written(evidence(df, items), "evidence")
    cells = _states(found, len(items))
    known = cells.select("n", F.inline("cells")).where(F.col("state") != _UNKNOWN)
    counts: dict[int, dict[int, int]] = {}
    for row in known.groupBy("item", "state").agg(F.sum("n").alias("n")).collect():  # three an item
        counts.setdefault(row["item"], {})[row["state"]] = row["n"]
    rows, single = [], {}
    for i, item in enumerate(items):
        best = _allowed(item, counts.get(i, {}), error)
        if best:
            single[i] = best[0]
            text = item.condition(best[0])
            rows.append((text, item.columns, None, sum(counts[i].values()), best[1], f"NOT ({text})"))
    if implied:
        total = found.agg(F.sum("n")).first()[0] or 0
        rows += _implied(cells, items, counts, single, error, min_support * total)
    return local_frame(df.sparkSession, rows, SCHEMA)


def _implied(
    cells: DataFrame, items: list[Item], counts: dict, single: dict[int, str], error: float, support: float
) -> list[tuple]:
    """Conditions where another item is in one state, from counts of pairs of items."""
    state = {operator: next(iter(s)) for operator, s in _OPERATORS.items() if len(s) == 1}
    one, other = F.explode("cells").alias("one"), F.explode("cells").alias("other")
    pairs = (
        cells.select("n", "cells", one).select("n", "one", other)
        .where("one.item <> other.item")
        .where((F.col("one.state") != _UNKNOWN) & (F.col("other.state") != _UNKNOWN))
        .groupBy("one.item", "one.state", F.col("other.item").alias("then"), F.col("other.state").alias("found"))
        .agg(F.sum("n").alias("n"))
        .collect()  # nine for each pair of items
    )
    joint: dict[tuple, dict[int, int]] = {}
    for r in pairs:
        joint.setdefault((r["item"], r["state"], r["then"]), {})[r["found"]] = r["n"]
    rows = []
    for (i, at, then), found in sorted(joint.items()):
        enough = sum(found.values()) >= max(support, 1)
        narrower = counts[i].get(at, 0) < sum(counts[i].values())
        best = _allowed(items[then], found, error) if enough and narrower else None
        if not best or (then in single and _OPERATORS[single[then]] <= _OPERATORS[best[0]]):
            continue
        where = items[i].condition(next(o for o, s in state.items() if s == at))
        text = items[then].condition(best[0])
        rows.append((text, items[then].columns, where, sum(found.values()), best[1], f"{where} AND NOT ({text})"))
    return rows
