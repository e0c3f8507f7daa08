"""Row count of the source against that of the target."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def row_count(df: DataFrame, metric: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(metric).alias("metric"), "value")


def row_count_match(source: DataFrame, target: DataFrame) -> DataFrame:
    """One row: both counts, their absolute difference and PASS or FAIL."""
    counts = row_count(source, "source").unionByName(row_count(target, "target"))
    return counts.agg(
        F.max(F.when(F.col("metric") == "source", F.col("value"))).alias("source_rows"),
        F.max(F.when(F.col("metric") == "target", F.col("value"))).alias("target_rows"),
    ).select(
        "source_rows",
        "target_rows",
        F.abs(F.col("source_rows") - F.col("target_rows")).alias("rows_affected"),
        F.when(F.col("source_rows") == F.col("target_rows"), "PASS")
        .otherwise("FAIL")
        .alias("status"),
    )
