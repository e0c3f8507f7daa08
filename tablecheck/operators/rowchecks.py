"""Row-level checks: missing values, ranges, dates, patterns.

Each returns the violating rows. `fused_counts` counts any number of them, and the
table's rows, in a single scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, Observation, functions as F

from ..functions import predicates as P
from ..session import local_frame


def no_nulls_required(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return P.violating_rows(df, P.null_predicate(df.schema, columns))


def numeric_range(df: DataFrame, checks: Mapping[str, Mapping]) -> DataFrame:
    return P.violating_rows(df, P.numeric_range_predicate(df.schema, checks))


def date_range(df: DataFrame, checks: Mapping[str, Mapping]) -> DataFrame:
    return P.violating_rows(df, P.date_range_predicate(df.sparkSession, df.schema, checks))


def pattern_validation(df: DataFrame, patterns: Mapping[str, str]) -> DataFrame:
    return P.violating_rows(df, P.pattern_predicate(df.sparkSession, df.schema, patterns))


def fused_counts(df: DataFrame, predicates: Mapping[str, str], rows: str = "rows") -> DataFrame:
    """(metric, value): one row for the row count and one per predicate, from one scan.

    Only TRUE is counted, so a predicate that is NULL on a row does not violate.
    """
    counts = [F.count(F.lit(1)).alias("m0")]
    counts += [F.count_if(F.expr(p)).alias(f"m{i}") for i, p in enumerate(predicates.values(), 1)]
    pairs = [
        F.struct(F.lit(name).alias("metric"), F.col(f"m{i}").alias("value"))
        for i, name in enumerate([rows, *predicates])
    ]
    return df.agg(*counts).select(F.inline(F.array(*pairs)))


def counts_while_written(
    df: DataFrame,
    predicates: Mapping[str, str],
    write: Callable[[DataFrame], None],
    rows: str = "rows",
) -> DataFrame:
    """What `fused_counts` gives, counted while `write` stores the rows of `df`.

    The counts are observed on the rows that pass to the sink, so a load is checked without
    being read again. `write` must write the frame it is given once, whole; a task that is
    tried again does not count twice. If nothing was written this waits for it.
    """
    names = [rows, *predicates]
    counts = [F.count(F.lit(1)).alias("m0")]
    counts += [F.count_if(F.expr(p)).alias(f"m{i}") for i, p in enumerate(predicates.values(), 1)]
    seen = Observation()
    write(df.observe(seen, *counts))
    found = seen.get
    pairs = [(name, found[f"m{i}"]) for i, name in enumerate(names)]
    return local_frame(df.sparkSession, pairs, "metric string, value long")
