"""Checking a whole set of tables against a declared model."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import conformance
from ..operators.inclusion import implied_foreign_keys, not_a_key
from ..operators.renames import column_signatures, renamed_columns
from ..session import local_frame
from ..sources import tables as T


def validate_schema(
    spark: SparkSession,
    model: DataFrame,
    tables: T.Tables,
    names: Iterable[str],
    key_candidates: tuple[Iterable[tuple[str, str]], Iterable[tuple[str, str]]] | None = None,
    min_coverage: float = 1.0,
    earlier: T.Tables | None = None,
) -> DataFrame:
    """All findings for the tables listed; only columns of a wrong or narrower type are
    scanned.

    key_candidates: child and parent columns among which to look for foreign keys that
    the data implies; those below `min_coverage` are not reported, and one that cannot be
    a key is a finding of its own. earlier: an earlier load of the tables; a declared
    column that is missing now is looked for by its earlier values under a new name.
    """
    if key_candidates is not None:
        key_candidates = tuple(map(list, key_candidates))
    actual = T.columns(spark, tables, names)
    scans = [
        conformance.type_conformance(tables(table), columns).withColumn("table_name", F.lit(table))
        for table, columns in conformance.declared_differences(model, actual).items()
    ]
    conversions = reduce(DataFrame.unionByName, scans) if scans else None
    implied = no_keys = None
    if key_candidates is not None:
        reasons = {
            column: not_a_key(tables, column)
            for column in dict.fromkeys(c for side in map(list, key_candidates) for c in side)
        }
        children, parents = ([c for c in side if not reasons[c]] for side in key_candidates)
        if children and parents:
            implied = implied_foreign_keys(tables, children, parents, min_coverage)
        bad = [(*column, reason) for column, reason in reasons.items() if reason]
        if bad:
            no_keys = local_frame(spark, bad, "table_name string, column_name string, reason string")
    renamed = _renamed(model, actual, tables, earlier) if earlier is not None else None
    return conformance.schema_findings(model, actual, conversions, implied, no_keys, renamed)


def _renamed(
    model: DataFrame, actual: DataFrame, tables: T.Tables, earlier: T.Tables
) -> DataFrame | None:
    """Renamed columns of the tables that have both a missing and an undeclared one; only
    such columns are read."""
    found: dict[str, dict[str, list[str]]] = {}
    for row in conformance.column_differences(model, actual).where("difference <> 'type'").collect():
        found.setdefault(row.table_name, {}).setdefault(row.difference, []).append(row.column_name)
    parts = []
    for table, names in found.items():
        if len(names) < 2:
            continue
        before = earlier(table)
        gone = {c.lower() for c in names["missing"]}
        old = column_signatures(before, [c for c in before.columns if c.lower() in gone])
        new = column_signatures(tables(table), names["extra"])
        parts.append(renamed_columns(old, new).withColumn("table_name", F.lit(table)))
    return reduce(DataFrame.unionByName, parts) if parts else None


def required_columns(model: DataFrame) -> dict[str, list[str]]:
    """{table: columns declared not nullable}: what the runner takes as `required`."""
    found: dict[str, list[str]] = {}
    for row in model.where("NOT nullable").select("table_name", "column_name").collect():
        found.setdefault(row.table_name, []).append(row.column_name)
    return found


def schema_summary(findings: DataFrame, total_tables: int) -> DataFrame:
    """One row: total_tables and total_issues, which counts every finding."""
    return findings.agg(F.count(F.lit(1)).alias("total_issues")).select(
        F.lit(total_tables).cast("long").alias("total_tables"), "total_issues"
    )
