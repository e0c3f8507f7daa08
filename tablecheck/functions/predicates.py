"""Row-level checks as Spark SQL predicates that are TRUE for a violating row.

Column types are settled here, before any job: a check the warehouse would refuse
(a range on text, a malformed date bound) raises ValueError, so the predicates that
remain cannot fail on a row and are safe to fuse into one aggregate.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import regex
from .sqltext import number_literal, quote_column, string_literal
from .typing import (
    DATE,
    FLOAT,
    NESTED_KINDS,
    NUMBER_KINDS,
    STRING,
    TIME_KINDS,
    field_type,
    kind_of,
)


def any_of(conditions: Iterable[str]) -> str:
    return " OR ".join(conditions)


def null_predicate(schema: T.StructType, columns: Iterable[str]) -> str:
    for name in (columns := list(columns)):
        field_type(schema, name)
    return any_of(f"{quote_column(c, schema)} IS NULL" for c in columns)


def numeric_range_predicate(schema: T.StructType, checks: Mapping[str, Mapping]) -> str:
    """Values outside the inclusive bounds. NULL and NaN never violate."""
    conditions = []
    for name, bounds in checks.items():
        data_type = field_type(schema, name)
        if kind_of(data_type) not in NUMBER_KINDS:
            raise ValueError(f"numeric range on {name!r}, which is {data_type.simpleString()}")
        if bounds.get("min") is None or bounds.get("max") is None:
            raise ValueError(f"numeric range on {name!r} needs both min and max")
        column = quote_column(name, schema)
        low, high = (number_literal(bounds[k], data_type) for k in ("min", "max"))
        above = f"{column} > {high}"
        if kind_of(data_type) == FLOAT:
            # Spark sorts NaN above infinity; this keeps it out and still pushes down
            infinity = f"CAST('Infinity' AS {data_type.simpleString().upper()})"
            above = f"({above} AND {column} <= {infinity})"
        conditions.append(f"({column} < {low} OR {above})")
    return any_of(conditions)


def _probe_casts(spark: SparkSession | None, wanted: list[tuple[str, str]]) -> None:
    """Refuse bounds that do not convert; the one-row probe is folded by Catalyst. Without
    a session nothing is asked."""
    if spark is None:
        return
    casts = [f"TRY_CAST({string_literal(text)} AS {ddl}) IS NULL AS bad{i}"
             for i, (text, ddl) in enumerate(wanted)]
    if not casts:
        return
    bad = spark.sql("SELECT " + ", ".join(casts)).first()
    for (text, ddl), is_bad in zip(wanted, bad):
        if is_bad or (ddl == "DATE" and not re.fullmatch(r"\s*\d{4}-\d{1,2}-\d{1,2}\s*", text)):
            raise ValueError(f"{text!r} is not a valid {ddl}")


def date_range_predicate(
    spark: SparkSession | None, schema: T.StructType, checks: Mapping[str, Mapping]
) -> str:
    """Values outside the inclusive bounds. A day given for a timestamp is its midnight."""
    conditions, probes = [], []
    for name, bounds in checks.items():
        data_type = field_type(schema, name)
        kind = kind_of(data_type)
        if kind not in TIME_KINDS and kind != STRING:
            raise ValueError(f"date range on {name!r}, which is {data_type.simpleString()}")
        limits = [bounds.get("min_date"), bounds.get("max_date")]
        if None in limits:
            raise ValueError(f"date range on {name!r} needs both min_date and max_date")
        literals = [string_literal(str(x)) for x in limits]
        if kind != STRING:
            ddl = data_type.simpleString().upper()
            probes += [(str(x), ddl) for x in limits]
            literals = [f"CAST({x} AS {ddl})" for x in literals]
        column = quote_column(name, schema)
        conditions.append(f"({column} < {literals[0]} OR {column} > {literals[1]})")
    _probe_casts(spark, probes)
    return any_of(conditions)


def pattern_predicate(
    spark: SparkSession | None, schema: T.StructType, patterns: Mapping[str, str]
) -> str:
    """Values in which the pattern is found nowhere. NULL never violates."""
    conditions = []
    for name, pattern in patterns.items():
        data_type = field_type(schema, name)
        if kind_of(data_type) in NESTED_KINDS:
            raise ValueError(f"pattern on {name!r}, which is {data_type.simpleString()}")
        java = string_literal(regex.to_java(pattern))
        if spark is not None:
            spark.sql(f"SELECT '' RLIKE {java}").first()  # raises on a malformed pattern
        column = quote_column(name, schema)
        text = column if kind_of(data_type) == STRING else f"CAST({column} AS STRING)"
        conditions.append(f"(NOT {text} RLIKE {java})")
    return any_of(conditions)


def require_numbers(schema: T.StructType, columns: Iterable[str]) -> None:
    for name in columns:
        data_type = field_type(schema, name)
        if kind_of(data_type) not in NUMBER_KINDS:
            raise ValueError(f"outliers of {name!r}, which is {data_type.simpleString()}")


def violating_rows(df: DataFrame, predicate: str) -> DataFrame:
    return df.where(F.expr(predicate))
