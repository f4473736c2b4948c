"""Nested records, one a ticker, that later runs replace ticker by ticker."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from oddsmith.sources.readers import finite

DIGEST = "payload_digest"


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def replace(rows: DataFrame, path: str, key: str = "ticker", groups: int | None = None) -> None:
    """Writes the records of `rows` as JSON under `path`, a folder for each key, where they are new or differ from what is stored.

    Records of keys that `rows` lacks stay. The folders of changed keys are staged and exchanged when
    the whole job commits, so a failed run leaves the old records. `rows` has one row a key; NaN and
    infinities become null, in nested values too.

    Each folder takes its time to make, exchange and list, so many keys share `groups` folders by a hash: the number
    is the same at every writing and leaves some ten MB for a folder. A folder with a changed key is written anew,
    its other records as they stood; `rows` is then read twice.
    """
    spark = rows.sparkSession
    clean = rows.select(*[finite(F.col(f.name), f.dataType).alias(f.name) for f in rows.schema])
    record = F.to_json(F.struct(*[c for c in clean.columns if c != key]))
    fresh = clean.withColumn(DIGEST, F.md5(record))
    known = T.StructType([T.StructField(DIGEST, T.StringType()), rows.schema[key]])
    if groups:
        _replace_groups(fresh, path, key, groups, known)
        return
    if _exists(spark, path):
        old = spark.read.schema(known).json(path)
        _check(old, {DIGEST, key}, path)
        fresh = fresh.join(old, [key, DIGEST], "left_anti")
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).json(path)


def _replace_groups(fresh: DataFrame, path: str, key: str, groups: int, known: T.StructType) -> None:
    """Old lines of changed groups meet the new ones in the exchange that the writing needs, and go where their key has a new one."""
    spark, folder = fresh.sparkSession, f"group_of_{groups}"
    group = F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(groups)).cast("int")
    line = F.to_json(F.struct(*fresh.columns))
    lines = fresh.select(key, DIGEST, group.alias(folder), line.alias("value"), F.lit(True).alias("new"))
    if _exists(spark, path):
        old = spark.read.text(path)
        _check(old, {"value", folder}, path)
        old = old.select("value", F.from_json("value", known).alias("x")).select("value", f"x.{key}", f"x.{DIGEST}", F.lit(False).alias("new")).withColumn(folder, group)
        same = lines[key].eqNullSafe(old[key]) & (lines[DIGEST] == old[DIGEST])
        changed = F.broadcast(lines.join(old.select(key, DIGEST), same, "left_anti").select(folder).distinct())  # `groups` rows at most
        lines = lines.join(changed, folder, "left_semi").unionByName(old.join(changed, folder, "left_semi"))
    nth = F.row_number().over(Window.partitionBy(folder, key).orderBy(F.desc("new")))
    newest = lines.repartition(groups, folder).withColumn("nth", nth).filter("nth = 1")
    newest.select("value", folder).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(folder).text(path)


def _check(old: DataFrame, columns: set[str], path: str) -> None:
    if extra := set(old.columns) - columns:
        raise ValueError(f"{path} was written with other folders: {sorted(extra)}")


def stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The records under `path`, with the schema of the frame that was written."""
    return spark.read.schema(schema).json(path).select(*schema.names)
