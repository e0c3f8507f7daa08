"""Small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACES = r"[\x20\x09-\x0D]"
#: Fixed value: the word pattern of white-space separated words.
WORD = r"[^\x20\x09-\x0D]+"


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (NULL read as empty) and the columns asked for, nothing else."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only, so that every engine agrees."""
    return F.translate(text, UPPER, UPPER.lower())


def words_of(text: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def steps(last: Column) -> Column:
    """0, 1, ..., last - 1; empty if `last` is not positive."""
    return F.when(last > 0, F.sequence(F.lit(0), last - 1)).otherwise(
        F.array().cast("array<int>")
    )


def row_key(*columns: str) -> list[Column]:
    """Two hashes that stand for a row's content; the same row has the same key in
    every run of a task, which a generated id would not promise."""
    return [
        F.xxhash64(*columns).alias("key_a"),
        F.xxhash64(F.lit("second"), *columns[::-1], F.lit(11)).alias("key_b"),
    ]


def kept(spark: SparkSession, frame: DataFrame, name: str) -> DataFrame:
    """Writes the frame below the shared folder and reads it back.

    Cuts the lineage: what was computed is neither computed again nor lost with an
    executor.
    """
    path = shared_dir(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
