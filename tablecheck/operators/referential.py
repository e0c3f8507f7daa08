"""Foreign keys whose value has no match in the referenced column."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.sqltext import quote_column
from ..functions.typing import NUMBER_KINDS, field_type, is_id_name, kind_of


def comparable(child: tuple[str, T.DataType], parent: tuple[str, T.DataType]) -> str | None:
    """How to compare the two columns: None as they are, "string" after a cast.

    Different type families only compare when one of the names says it is an id.
    """
    (child_name, child_type), (parent_name, parent_type) = child, parent
    kinds = {kind_of(child_type), kind_of(parent_type)}
    if len(kinds) == 1 or kinds <= NUMBER_KINDS:
        return None
    if is_id_name(child_name) or is_id_name(parent_name):
        return "string"
    raise ValueError(
        f"cannot compare {child_name} {child_type.simpleString()}"
        f" with {parent_name} {parent_type.simpleString()}"
    )


def orphan_values(df: DataFrame, column: str, ref: DataFrame, ref_column: str) -> DataFrame:
    """(fk_column, invalid_value, occurrence_count), one row per value without a match.

    Both sides are reduced to distinct values before they meet, so however often one
    value occurs, the anti join sees it once and no task holds a hot key.
    """
    cast_to = comparable(
        (column, field_type(df.schema, column)), (ref_column, field_type(ref.schema, ref_column))
    )
    child = F.col(quote_column(column, df.schema))
    parent = F.col(quote_column(ref_column, ref.schema))
    if cast_to:
        child, parent = child.cast(cast_to), parent.cast(cast_to)
    used = (
        df.select(child.alias("invalid_value"))
        .where("invalid_value IS NOT NULL")
        .groupBy("invalid_value")
        .agg(F.count(F.lit(1)).alias("occurrence_count"))
    )
    known = ref.select(parent.alias("known")).where("known IS NOT NULL").distinct()
    return used.join(known, F.col("invalid_value") == F.col("known"), "left_anti").select(
        F.lit(column).alias("fk_column"),
        F.col("invalid_value").cast("string").alias("invalid_value"),
        "occurrence_count",
    )


def referential_integrity(
    df: DataFrame,
    checks: Mapping[str, Mapping[str, str]],
    table: Callable[[str], DataFrame],
) -> DataFrame:
    """Orphan values of every foreign key in `checks`: {column: {table, column}}."""
    parts = [
        orphan_values(df, column, table(ref["table"]), ref["column"])
        for column, ref in checks.items()
    ]
    return reduce(DataFrame.unionByName, parts)
