"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession, types as T

CHECKPOINT_DIR = "spark.checkpoint.dir"

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


_FIRST_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def build_session(
    app_name: str = "tablecheck", conf: Mapping[str, str] | None = None
) -> SparkSession:
    """A session with the settings the checks assume, `conf` winning over them.

    Shuffles start with three partitions per core; adaptive execution merges those that
    turn out small, so one setting serves small and large tables.
    """
    conf = dict(conf or {})
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    if _FIRST_PARTITIONS not in conf and "spark.sql.shuffle.partitions" not in conf:
        partitions = max(200, 3 * spark.sparkContext.defaultParallelism)
        spark.conf.set(_FIRST_PARTITIONS, str(partitions))
    return spark


def local_frame(spark: SparkSession, rows: Iterable, schema: T.StructType | str) -> DataFrame:
    """A frame of a few driver-side rows, such as results or schemas, in one partition.

    Without this a handful of rows would be spread over as many tasks as there are cores.
    """
    return spark.createDataFrame(list(rows), schema).coalesce(1)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder every executor can reach, below `spark.checkpoint.dir`.

    A machine-local folder is only made for a local master, where driver and
    executors share one machine.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="tablecheck-")
    return f"{base.rstrip('/')}/tablecheck/{name}-{uuid.uuid4().hex}"


def written(frame: DataFrame, name: str) -> DataFrame:
    """Writes a frame below the shared folder and reads it back, so that frames made from
    it do not compute it again."""
    path = shared_dir(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
