"""Rendering names and literals as Spark SQL text.

Row-level checks are written once, as Spark SQL predicates: the same text runs
inside the fused aggregate and is reported as the check's `sql_query`.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import types as T

from .typing import is_floating


def quote_part(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def quote_column(name: str, schema: T.StructType | None = None) -> str:
    """`a.b` is nested access unless a top-level column carries that very name."""
    if schema is not None and name.lower() in {f.name.lower() for f in schema.fields}:
        return quote_part(name)
    return ".".join(quote_part(part) for part in name.split("."))


def quote_table(name: str) -> str:
    return ".".join(quote_part(part) for part in name.split("."))


def string_literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def number_literal(value, data_type: T.DataType) -> str:
    """A bound as the literal that compares exactly with a column of `data_type`."""
    if isinstance(value, bool) or value is None:
        raise ValueError(f"range bound {value!r} is not a number")
    number = Decimal(str(value))
    if not number.is_finite():
        raise ValueError(f"range bound {value!r} is not finite")
    if is_floating(data_type):
        return f"{float(number)!r}D"
    if number == number.to_integral_value() and abs(number) < 2**63:
        return str(int(number))
    return f"{number:f}BD"
