"""User-written check SQL: a query that returns the violating rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def is_blank(query: str | None) -> bool:
    return not (query or "").strip().rstrip(";").strip()


def violation_count(spark: SparkSession, query: str) -> DataFrame:
    """(rows_violating) of one query.

    The text is placed in a subquery, where only a single SELECT parses: statements
    that would change anything are refused before they can run.
    """
    body = query.strip().rstrip(";").strip()
    return spark.sql(f"SELECT count(*) AS rows_violating FROM (\n{body}\n) AS check_rows")
