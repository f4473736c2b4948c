"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only where it is unset and Spark runs in this process alone (as in tests) a temporary folder is
    taken; on a cluster that folder would not be shared, so there it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.conf.get("spark.oddsmith.local.dir", None)
        if not path:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            path = tempfile.mkdtemp(prefix="spark-shared-")
            spark.conf.set("spark.oddsmith.local.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read again: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["shared_path"] = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table from `written` that is needed no more."""
    spark = df.sparkSession
    if path := df.__dict__.pop("shared_path", None):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables that an operator writes on its way and deletes when its result stands on its own."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(written(df, name))
        return self.tables[-1]

    def clear(self, *but: DataFrame) -> None:
        for table in self.tables:
            if not any(table is t for t in but):
                dropped(table)
        self.tables = [*but]


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of `batches` in pieces of about `most` bytes of `column` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(size, dtype=np.int64), 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_key(text: str) -> Column:
    """A 16-byte hash that stands for a text; null has the key of the empty text."""
    return F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))))


def plainly(docs: DataFrame, known: Iterable[str], but: Iterable[str] = ()) -> tuple[DataFrame, list[str]]:
    """`docs` without the columns `but`, all others than `known` under names of no meaning; and their own names.

    What an operator calls its own columns can't meet those of a table then; `toDF` gives the names back.
    """
    known, names = set(known), [c for c in docs.columns if c not in set(but)]
    return docs.select(*[F.col(f"`{c}`").alias(c if c in known else f"c{i}") for i, c in enumerate(names)]), names


def uniform(*keys: Column) -> Column:
    """A number in (0, 1) from the first 12 hexadecimal digits of an MD5 over `keys` joined by ':'.

    DuckDB's md5 gives the same value, so results that depend on it have an SQL oracle.
    """
    digest = F.md5(F.concat_ws(":", *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys]))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16**12))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
