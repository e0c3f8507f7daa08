"""Duplicate keys and duplicate whole rows.

Counting is a hash aggregate with a map-side part, so a key that holds a third of
the table reaches the shuffle as one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.sqltext import quote_column
from ..functions.typing import field_type

_WIDE = (T.StringType, T.BinaryType, T.ArrayType, T.StructType)
_ROW_HASH = "__row_hash"


def no_duplicates_pk(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Key values that occur more than once; NULL keys are equal to each other."""
    for name in key:
        field_type(df.schema, name)
    return (
        df.groupBy(*(F.col(quote_column(name, df.schema)) for name in key))
        .agg(F.count(F.lit(1)).alias("duplicate_count"))
        .where(F.col("duplicate_count") > 1)
    )


def _count_equal_rows(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    return (
        rows.groupBy(*names)
        .agg(F.count(F.lit(1)).alias("duplicate_count"))
        .where(F.col("duplicate_count") > 1)
    )


def full_row_duplicates(df: DataFrame) -> DataFrame:
    """Rows whose every column is repeated, once each with their count.

    Shuffling wide rows to find the few that repeat is wasteful, so wide tables are
    first reduced to row hashes; only rows whose hash repeats are compared whole. The
    join with the repeated hashes is left to Spark, which broadcasts them if they are few.
    Equality of all columns decides, and equal rows are collapsed before they are shuffled.
    """
    names = [quote_column(c, df.schema) for c in df.columns]
    if not any(isinstance(f.dataType, _WIDE) for f in df.schema.fields):
        return _count_equal_rows(df, names)
    hashed = df.withColumn(_ROW_HASH, F.xxhash64(*names))
    repeated = hashed.groupBy(_ROW_HASH).count().where("count > 1").select(_ROW_HASH)
    return _count_equal_rows(hashed.join(repeated, _ROW_HASH, "left_semi"), names)
