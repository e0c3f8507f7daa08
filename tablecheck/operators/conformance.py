"""Real tables against a declared model.

The model is a frame (table_name, column_name, data_type, nullable, ref_table,
ref_column), one row per declared column. Comparing schemas is metadata work; the
part that grows with the data is counting the values that do not fit their type.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.sqltext import quote_column
from ..functions.typing import (
    NESTED_KINDS,
    NUMBER_KINDS,
    declared_type,
    field_type,
    kind_of,
)
from ..session import local_frame

MODEL_SCHEMA = (
    "table_name string, column_name string, data_type string, nullable boolean,"
    " ref_table string, ref_column string"
)
FINDING_SCHEMA = (
    "test_name string, category string, status string, severity string, description string,"
    " sql_query string, rows_affected bigint, rows_violating bigint, table_name string,"
    " column_name string"
)
CATEGORY = "schema_validation"

# Columns per aggregate: more would outgrow what Spark compiles into one method.
WIDTH = 100


def _kinds(model: DataFrame) -> DataFrame:
    """The model with the kind of each declared type; type names are few."""
    spark = model.sparkSession
    names = [r.data_type for r in model.select("data_type").distinct().collect()]
    lookup = local_frame(
        spark,
        [(n, kind_of(declared_type(n))) for n in names if n],
        "data_type string, kind string",
    )
    return model.join(F.broadcast(lookup), "data_type", "left")


def missing_tables(model: DataFrame, actual: DataFrame) -> DataFrame:
    return model.select("table_name").distinct().join(actual, "table_name", "left_anti")


def column_differences(model: DataFrame, actual: DataFrame) -> DataFrame:
    """(table_name, column_name, difference, declared, found) of tables in both.

    difference is "missing", "extra" or "type"; names are compared ignoring case, and
    types by kind, so that a declared bigint is met by an int.
    """
    declared = _kinds(model).select(
        F.col("table_name"), F.lower("column_name").alias("name"),
        F.col("column_name").alias("declared_name"), F.col("data_type").alias("declared"),
        F.col("kind").alias("declared_kind"),
    )
    found = actual.join(model.select("table_name").distinct(), "table_name", "left_semi").select(
        F.col("table_name"), F.lower("column_name").alias("name"),
        F.col("column_name").alias("found_name"), F.col("data_type").alias("found"),
        F.col("kind").alias("found_kind"),
    )
    present = declared.join(actual.select("table_name").distinct(), "table_name", "left_semi")
    difference = (
        F.when(F.col("found_name").isNull(), "missing")
        .when(F.col("declared_name").isNull(), "extra")
        .when(F.col("declared_kind") != F.col("found_kind"), "type")
    )
    return (
        present.join(found, ["table_name", "name"], "full_outer")
        .withColumn("difference", difference)
        .where("difference IS NOT NULL")
        .select(
            "table_name",
            F.coalesce("found_name", "declared_name").alias("column_name"),
            "difference",
            "declared",
            "found",
        )
    )


def type_conformance(df: DataFrame, declared: Mapping[str, str]) -> DataFrame:
    """(column_name, declared, n_values, unconvertible) of several columns, counted
    together; wide tables WIDTH columns at a time."""
    names = list(declared)
    parts = [names[at : at + WIDTH] for at in range(0, len(names), WIDTH)]
    return reduce(
        DataFrame.unionByName,
        (_conformance(df, {name: declared[name] for name in part}) for part in parts),
    )


def _conformance(df: DataFrame, declared: Mapping[str, str]) -> DataFrame:
    aggregates, rows = [], []
    for i, (name, type_name) in enumerate(declared.items()):
        column = F.col(quote_column(name, df.schema))
        wanted, found = declared_type(type_name), field_type(df.schema, name)
        nested = kind_of(wanted) in NESTED_KINDS or kind_of(found) in NESTED_KINDS
        if not nested:
            fitted = column.try_cast(wanted)
            unfit = fitted.isNull()
            if kind_of(wanted) in NUMBER_KINDS and kind_of(found) in NUMBER_KINDS:
                # a number that comes back as another one has lost something
                unfit = unfit | ~fitted.try_cast(found).eqNullSafe(column)
            bad = F.count_if(column.isNotNull() & unfit)
        elif wanted == found:
            bad = F.count_if(F.lit(False))
        else:
            bad = F.count(column)
        aggregates += [F.count(column).alias(f"n{i}"), bad.alias(f"bad{i}")]
        rows.append(
            F.struct(
                F.lit(name).alias("column_name"),
                F.lit(type_name).alias("declared"),
                F.col(f"n{i}").alias("n_values"),
                F.col(f"bad{i}").alias("unconvertible"),
            )
        )
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def _finding(
    rows: DataFrame, name: str, status: str, severity: str, text: Column,
    violating: Column | None = None, column: Column | None = None,
) -> DataFrame:
    return rows.select(
        F.lit(name).alias("test_name"),
        F.lit(CATEGORY).alias("category"),
        F.lit(status).alias("status"),
        F.lit(severity).alias("severity"),
        text.alias("description"),
        F.lit("").alias("sql_query"),
        F.lit(0).cast("long").alias("rows_affected"),
        (F.lit(0).cast("long") if violating is None else violating).alias("rows_violating"),
        F.col("table_name"),
        (F.lit(None).cast("string") if column is None else column).alias("column_name"),
    )


def schema_findings(
    model: DataFrame,
    actual: DataFrame,
    conversions: DataFrame | None = None,
    implied: DataFrame | None = None,
    no_keys: DataFrame | None = None,
    renamed: DataFrame | None = None,
) -> DataFrame:
    """Every difference as a result row.

    conversions: `type_conformance` rows with their table_name; implied: rows of
    `implied_foreign_keys`, reported where the model declares no reference; no_keys:
    (table_name, column_name, reason) of candidates that can't be keys; renamed: rows of
    `renamed_columns` with their table_name, each reported once, in place of a missing
    and an undeclared column.
    """
    text = F.format_string
    differences = column_differences(model, actual)
    if renamed is not None:
        lower = F.lower("column_name").alias("name")
        for name, kind in (("old_name", "missing"), ("new_name", "extra")):
            known = renamed.select("table_name", F.lower(name).alias("name"), F.lit(kind).alias("difference"))
            differences = (
                differences.withColumn("name", lower)
                .join(F.broadcast(known), ["table_name", "name", "difference"], "left_anti")
                .drop("name")
            )
    column = F.col("column_name")

    def of(kind: str) -> DataFrame:
        return differences.where(F.col("difference") == kind)

    parts = [
        _finding(missing_tables(model, actual), "Missing table", "FAIL", "HIGH",
                 text("table %s is declared but does not exist", "table_name")),
        _finding(of("missing"), "Missing column", "FAIL", "HIGH",
                 text("column %s.%s is declared but does not exist", "table_name", column),
                 column=column),
        _finding(of("extra"), "Undeclared column", "WARNING", "LOW",
                 text("column %s.%s is not declared", "table_name", column), column=column),
        _finding(of("type"), "Wrong column type", "FAIL", "MEDIUM",
                 text("column %s.%s is %s, declared %s", "table_name", column, "found", "declared"),
                 column=column),
    ]
    if conversions is not None:
        parts.append(
            _finding(conversions.where("unconvertible > 0"), "Values of the wrong type", "FAIL",
                     "MEDIUM",
                     text("%d of %d values of %s.%s do not convert to %s", "unconvertible",
                          "n_values", "table_name", column, "declared"),
                     violating=F.col("unconvertible"), column=column)
        )
    if renamed is not None:
        parts.append(
            _finding(renamed, "Renamed column", "WARNING", "MEDIUM",
                     text("column %s.%s seems to be %s now: %.2f of its values agree",
                          "table_name", "old_name", "new_name", "similarity"),
                     column=F.col("new_name"))
        )
    if no_keys is not None:
        parts.append(
            _finding(no_keys, "Not a possible key", "INFO", "LOW", F.col("reason"),
                     column=column)
        )
    if implied is not None:
        declared = model.where("ref_table IS NOT NULL").select(
            F.col("table_name").alias("child_table"), F.col("column_name").alias("child_column"),
            F.col("ref_table").alias("parent_table"), F.col("ref_column").alias("parent_column"),
        )
        new = implied.join(F.broadcast(declared), declared.columns, "left_anti").withColumn(
            "table_name", F.col("child_table")
        )
        parts.append(
            _finding(new, "Implied foreign key", "INFO", "MEDIUM",
                     text("%d of %d values of %s.%s occur in %s.%s", "matched", "distinct_values",
                          "child_table", "child_column", "parent_table", "parent_column"),
                     violating=F.col("distinct_values") - F.col("matched"),
                     column=F.col("child_column"))
        )
    return reduce(DataFrame.unionByName, parts)


_WIDTHS = {T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4,
           T.DoubleType: 8}


def _holds_all(wanted: T.DataType, found: T.DataType) -> bool:
    """Whether a declared type of the same kind takes every value of the real one."""
    if isinstance(wanted, T.DecimalType) and isinstance(found, T.DecimalType):
        whole = wanted.precision - wanted.scale >= found.precision - found.scale
        return whole and wanted.scale >= found.scale
    return _WIDTHS.get(type(wanted), 0) >= _WIDTHS.get(type(found), 0)


def declared_differences(model: DataFrame, actual: DataFrame) -> dict[str, dict[str, str]]:
    """{table: {column: declared type}} of the columns to scan: those of another kind, and
    those whose declared type is narrower than the real one."""
    declared = _kinds(model).select(
        "table_name", F.lower("column_name").alias("name"), "kind", F.col("data_type").alias("declared")
    )
    real = actual.select(
        "table_name", F.lower("column_name").alias("name"), "column_name",
        F.col("kind").alias("found_kind"), F.col("data_type").alias("found_type"),
    )
    found: dict[str, dict[str, str]] = {}
    for row in declared.join(real, ["table_name", "name"]).where("declared IS NOT NULL").collect():
        same = row.kind == row.found_kind
        if not same or not _holds_all(declared_type(row.declared), declared_type(row.found_type)):
            found.setdefault(row.table_name, {})[row.column_name] = row.declared
    return found
