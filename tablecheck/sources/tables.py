"""Loaded tables: looking them up, their columns, sizes and head rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.errors import AnalysisException

from ..functions.typing import kind_of
from ..session import local_frame

Tables = Callable[[str], DataFrame]

COLUMNS_SCHEMA = T.StructType(
    [
        T.StructField("table_name", T.StringType()),
        T.StructField("position", T.IntegerType()),
        T.StructField("column_name", T.StringType()),
        T.StructField("data_type", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("mode", T.StringType()),
    ]
)


def from_catalog(spark: SparkSession) -> Tables:
    """Tables of the session catalog; a leading project name is dropped."""

    def table(name: str) -> DataFrame:
        parts = name.replace("`", "").split(".")
        return spark.table(".".join(f"`{p}`" for p in parts[-2:]))

    return table


def from_frames(frames: Mapping[str, DataFrame]) -> Tables:
    """Named frames; `project.dataset.table` falls back to shorter names."""

    def table(name: str) -> DataFrame:
        parts = name.replace("`", "").split(".")
        for start in range(len(parts)):
            found = frames.get(".".join(parts[start:]))
            if found is not None:
                return found
        raise ValueError(f"table {name!r} not found")

    return table


def from_directory(spark: SparkSession, directory: str) -> Tables:
    """`<directory>/<table>.parquet`."""

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{directory.rstrip('/')}/{name.split('.')[-1]}.parquet")

    return table


def table_names(spark: SparkSession, databases: Iterable[str]) -> list[str]:
    """Tables of several databases; a database that cannot be listed is skipped."""
    names = []
    for database in databases:
        try:
            listed = spark.catalog.listTables(database)
        except AnalysisException:
            continue
        names += [f"{database}.{t.name}" for t in listed if not t.isTemporary]
    return names


def columns(
    spark: SparkSession,
    table: Tables,
    names: Iterable[str],
    required: Mapping[str, Iterable[str]] | None = None,
) -> DataFrame:
    """(table_name, position, column_name, data_type, kind, mode), unreadable tables skipped.

    Files do not record which columns must be filled, so `mode` comes from `required`.
    """
    rows = []
    for name in names:
        try:
            schema = table(name).schema
        except (AnalysisException, ValueError):
            continue
        must = {c.lower() for c in (required or {}).get(name, ())}
        rows += [
            (name, i, f.name, f.dataType.simpleString(), kind_of(f.dataType),
             "REQUIRED" if f.name.lower() in must else "NULLABLE")
            for i, f in enumerate(schema.fields)
        ]
    return local_frame(spark, rows, COLUMNS_SCHEMA)


def _size(name: str, df: DataFrame) -> DataFrame:
    try:
        modified = F.col("_metadata.file_modification_time")
        df.select(modified)
    except AnalysisException:  # not a frame over files
        modified = F.lit(None).cast("timestamp")
    return df.agg(
        F.count(F.lit(1)).alias("num_rows"),
        F.min(modified).alias("created"),
        F.max(modified).alias("modified"),
    ).select(
        F.lit(name).alias("table_name"),
        F.lit(len(df.columns)).cast("long").alias("num_columns"),
        "num_rows",
        "created",
        "modified",
    )


def metadata(table: Tables, names: Iterable[str]) -> DataFrame:
    """(table_name, num_columns, num_rows, created, modified); times are of the data files."""
    return reduce(DataFrame.unionByName, (_size(name, table(name)) for name in names))


def head(df: DataFrame, n: int = 5, order_by: Iterable[str] = ()) -> DataFrame:
    """The first rows; with `order_by` always the same ones."""
    keys = list(order_by)
    return (df.orderBy(*keys) if keys else df).limit(n)
