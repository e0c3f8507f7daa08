"""Keeping the jobs of one mapping apart from those of the others."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Seconds between attempts to cancel: a mapping over its time may start another job.
_AGAIN = 0.5
_POOL = "spark.scheduler.pool"


class TimeLimit:
    """Whether the mapping was stopped because its time was over."""

    def __init__(self, seconds: float | None):
        self.seconds = seconds
        self.over = False

    def message(self) -> str:
        return f"stopped after {self.seconds:g} seconds"


@contextmanager
def jobs_of(spark: SparkSession, name: str, seconds: float | None = None) -> Iterator[TimeLimit]:
    """Jobs this thread starts meanwhile run in a scheduler pool of their own (with
    spark.scheduler.mode=FAIR pools share the executors evenly) and are cancelled, they
    and no others, once `seconds` have passed."""
    context = spark.sparkContext
    tag = f"tablecheck-{uuid.uuid4().hex}"
    limit = TimeLimit(seconds)
    done = threading.Event()

    def watch() -> None:
        if done.wait(seconds):
            return
        limit.over = True
        while True:
            context.cancelJobsWithTag(tag)
            if done.wait(_AGAIN):
                return

    pool = context.getLocalProperty(_POOL)
    context.addJobTag(tag)
    context.setLocalProperty(_POOL, name)
    watcher = threading.Thread(target=watch, daemon=True) if seconds is not None else None
    if watcher:
        watcher.start()
    try:
        yield limit
    finally:
        done.set()
        if watcher:
            watcher.join()
        context.removeJobTag(tag)
        context.setLocalProperty(_POOL, pool)
