"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


_made: dict[str, list[Callable[[], object]]] = {}  # by session: how to remove what its jobs have left


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under the session's spark.checkpoint.dir; `clear` removes it.

    Where that is unset and Spark runs in this process alone (as in tests), under a temporary
    folder; on a cluster that folder would not be shared, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-shared-")
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    on_clear(spark, lambda: delete(spark, path))
    return path


def on_clear(spark: SparkSession, action: Callable[[], object]) -> None:
    _made.setdefault(spark._jsparkSession.sessionUUID(), []).append(action)


def clear(spark: SparkSession) -> None:
    """Removes the folders and tables that the session's jobs have left. Results that still read them are lost."""
    for action in reversed(_made.pop(spark._jsparkSession.sessionUUID(), [])):
        action()


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder on whatever file system it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
