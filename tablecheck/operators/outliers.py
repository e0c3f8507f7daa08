"""Values more than three sample standard deviations from their column's mean."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.predicates import require_numbers
from ..functions.sqltext import quote_column

SIGMAS = 3


def _distance_predicate(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """One predicate per column over the statistics of all, gathered in one scan."""
    values = [F.col(quote_column(c, df.schema)).cast("double") for c in columns]
    stats = df.agg(
        F.struct(
            *(F.avg(v).alias(f"mean{i}") for i, v in enumerate(values)),
            *(F.stddev_samp(v).alias(f"sd{i}") for i, v in enumerate(values)),
        ).alias("stats")
    ).scalar()
    return [
        F.abs(v - stats[f"mean{i}"]) > SIGMAS * stats[f"sd{i}"] for i, v in enumerate(values)
    ]


def chosen_columns(columns: Sequence[str], which: str = "first") -> list[str]:
    if which not in ("first", "all"):
        raise ValueError(f"columns must be 'first' or 'all', not {which!r}")
    return list(columns)[:1] if which == "first" else list(columns)


def outlier_detection(df: DataFrame, columns: Sequence[str], which: str = "first") -> DataFrame:
    """Rows with an outlier in the first column listed, or in any with which="all".

    The statistics reach the filter as a scalar subquery: no join and no collect.
    """
    columns = chosen_columns(columns, which)
    require_numbers(df.schema, columns)
    predicates = _distance_predicate(df, columns)
    condition = predicates[0]
    for p in predicates[1:]:
        condition = condition | p
    return df.where(condition)
