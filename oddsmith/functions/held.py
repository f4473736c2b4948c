"""Frames that a job reads more than once: kept on the executors until the next job begins."""

from __future__ import annotations

import threading
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_held: dict[tuple[str, int], list[DataFrame]] = {}


def _job(spark: SparkSession) -> tuple[str, int]:
    """A session's jobs in other threads are jobs of their own."""
    return spark._jsparkSession.sessionUUID(), threading.get_ident()


def hold(df: DataFrame) -> DataFrame:
    """Persists `df` in memory or on disk; a lost executor's part is computed again."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    _held.setdefault(_job(df.sparkSession), []).append(kept)
    return kept


def release(spark: SparkSession) -> None:
    """Gives up what this thread's last job of the session has held. A result that still reads a frame computes it anew."""
    for df in _held.pop(_job(spark), []):
        df.unpersist()
