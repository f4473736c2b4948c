"""A store of daily prices, bucketed by ticker, that grows by whole tickers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsmith.functions.shared import delete

COLUMNS = ("ticker", "date", "close", "volume")


class PriceStore:
    """A table of prices in `buckets` buckets by ticker, sorted by ticker and date within each file.

    Jobs that work along a ticker read it without an exchange: a bucket's files are one partition
    that holds all rows of its tickers. Choose the number of buckets once, so that a bucket of the
    whole store fits a task (a hundred MB or so); it also is how many tasks read the store. A
    ticker's rows, one a trading day, lie in one bucket.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = 64):
        self.spark, self.name, self.path, self.buckets = spark, name, path.rstrip("/"), buckets

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def prices(self) -> DataFrame:
        return self.spark.table(self.name)

    def tickers(self) -> DataFrame:
        """ticker, n_rows, first, last of all that is stored; by bucket, without an exchange."""
        return self.prices().groupBy("ticker").agg(F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first"), F.max("date").alias("last"))

    def unstored(self, feed: DataFrame) -> DataFrame:
        """Rows of `feed` whose ticker is not in the store yet."""
        if not self.exists():
            return feed
        stored = self.prices().select("ticker").distinct()
        return feed.repartition(self.buckets, "ticker").join(stored, "ticker", "left_anti")

    def ingest(self, feed: DataFrame) -> None:
        """Appends the rows of all tickers that are not stored yet; stored ones stay as they are.

        Rows without ticker, date or close are left out. A ticker comes whole or not at all: files
        of an ingest that fails are not committed, and the next ingest finds its tickers missing.
        `feed` is read once. Every ingest adds one file to a bucket; `compact` makes them one again.
        """
        rows = feed.select(*COLUMNS).dropna(subset=["ticker", "date", "close"])
        self._write(self.unstored(rows), self.name, f"{self.path}/{uuid.uuid4().hex}" if not self.exists() else None)

    def _write(self, rows: DataFrame, name: str, path: str | None) -> None:
        dealt = rows.repartition(self.buckets, "ticker").sortWithinPartitions("ticker", "date")
        writer = dealt.write.format("parquet").bucketBy(self.buckets, "ticker").sortBy("ticker", "date").mode("append")
        (writer.option("path", path) if path else writer).saveAsTable(name)

    def _location(self) -> str:
        rows = self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.name}").filter("col_name = 'Location'").collect()
        return rows[0]["data_type"]

    def compact(self) -> None:
        """Rewrites the store with one file a bucket and puts the new table in the old one's place."""
        old, fresh = self._location(), f"{self.name}_{uuid.uuid4().hex}"
        self._write(self.prices(), fresh, f"{self.path}/{uuid.uuid4().hex}")
        self.spark.sql(f"DROP TABLE {self.name}")
        self.spark.sql(f"ALTER TABLE {fresh} RENAME TO {self.name}")
        delete(self.spark, old)

    def drop(self) -> None:
        """Removes the table and its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(self.spark, self.path)
