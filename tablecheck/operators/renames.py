"""Columns that were renamed, recognised by their values.

A column's signature is the smallest of each of many hashes of its values, so two columns
agree in a place of their signatures with the chance that is their Jaccard similarity.
Signatures of all columns of a table come from one aggregate, merge, and are of fixed
size; which missing column became which new one is an assignment between them.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from ..functions.sqltext import quote_part
from ..functions.typing import NESTED_KINDS, NUMBER_KINDS, kind_of
from ..session import local_frame

#: Places of a signature; the similarity is off by 1 / (2 * sqrt(PLACES)) as a rule.
PLACES = 64
#: Columns per aggregate.
WIDTH = 20

SIGNATURES = "column_name string, kind string, rows long, filled long, signature array<bigint>"


def column_signatures(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """column_name, kind, rows, filled (rows with a value) and signature (NULL without any
    value) of the columns that are not nested. Numbers are compared by value whatever
    their type, everything else as text."""
    kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields}
    names = [c for c in (columns or kinds) if kinds[c] not in NESTED_KINDS]
    parts = []
    for at in range(0, len(names), WIDTH):
        own = names[at : at + WIDTH]
        aggregates, cells = [F.count(F.lit(1)).alias("rows")], []
        for i, name in enumerate(own):
            column = F.col(quote_part(name))
            value = column.cast("double") + F.lit(0.0) if kinds[name] in NUMBER_KINDS else column.cast("string")
            first = F.xxhash64(value)
            hashes = [F.min(F.when(value.isNotNull(), F.xxhash64(F.lit(k), first))) for k in range(PLACES)]
            aggregates.append(F.count(value).alias(f"n{i}"))
            aggregates += [h.alias(f"h{i}_{k}") for k, h in enumerate(hashes)]
            places = F.array(*(F.col(f"h{i}_{k}") for k in range(PLACES)))
            cells.append(
                F.struct(
                    F.lit(name).alias("column_name"),
                    F.lit("number" if kinds[name] in NUMBER_KINDS else kinds[name]).alias("kind"),
                    F.col("rows"),
                    F.col(f"n{i}").alias("filled"),
                    F.when(F.col(f"n{i}") > 0, places).alias("signature"),
                )
            )
        parts.append(df.agg(*aggregates).select(F.inline(F.array(*cells))))
    if not parts:
        return local_frame(df.sparkSession, [], SIGNATURES)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def similarity(one: list[int] | None, other: list[int] | None) -> float:
    if not one or not other:
        return 0.0
    return sum(a == b for a, b in zip(one, other, strict=True)) / len(one)


def assigned(worth: list[list[float]]) -> list[tuple[int, int]]:
    """(row, column) pairs, each used once, of the greatest total worth: repeatedly the
    path of exchanges that gains most, until none gains."""
    if not worth or not worth[0]:
        return []
    rows, columns = len(worth), len(worth[0])
    row_of = [-1] * columns
    for start in range(rows):
        # longest path from the new row to a free column, by relaxing all exchanges
        best = list(worth[start])
        via = [start] * columns
        for _ in range(rows):
            changed = False
            for c in range(columns):
                r = row_of[c]
                if r < 0:
                    continue
                for d in range(columns):
                    gain = best[c] - worth[r][c] + worth[r][d]
                    if d != c and gain > best[d] + 1e-12:
                        best[d], via[d], changed = gain, r, True
            if not changed:
                break
        # or leave a row without a column
        end, most, left = -1, 0.0, -1
        for c in range(columns):
            r = row_of[c]
            gain = best[c] if r < 0 else best[c] - worth[r][c]
            if gain > most + 1e-12:
                end, most, left = c, gain, r
        if end < 0:
            continue
        column_of = {r: c for c, r in enumerate(row_of) if r >= 0}
        c = end
        while True:
            r = via[c]
            old = column_of.get(r, -1)
            row_of[c] = r
            if r == start:
                break
            c = old
    return sorted((r, c) for c, r in enumerate(row_of) if r >= 0)


def renamed_columns(
    before: DataFrame, after: DataFrame, min_similarity: float = 0.5
) -> DataFrame:
    """old_name, new_name and similarity of columns of `before` that `after` has under
    another name. Both are frames of `column_signatures`.

    Names are compared ignoring case; only columns that the other side lacks, of the same
    kind and of at least `min_similarity` are matched, each with one other, so that the
    similarities add up to the most.
    """
    old, new = ({r.column_name: r for r in side.collect()} for side in (before, after))  # one row a column
    gone = [c for c in old if c.lower() not in {n.lower() for n in new}]
    come = [c for c in new if c.lower() not in {n.lower() for n in old}]

    def worth(a: str, b: str) -> float:
        found = similarity(old[a].signature, new[b].signature) if old[a].kind == new[b].kind else 0.0
        return found if found >= min_similarity else 0.0

    table = [[worth(a, b) for b in come] for a in gone]
    rows = [(gone[i], come[j], table[i][j]) for i, j in assigned(table) if table[i][j] > 0]
    return local_frame(
        before.sparkSession, rows, "old_name string, new_name string, similarity double"
    )
