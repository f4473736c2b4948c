"""Bootstrap intervals, calibration and rank statistics by grouped sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oddsmith.functions.held import hold

DRAWS = 2000
BINS = 4096  # of scores, for ranks


def hashed_start(seed: int, draw: Column, block: Column, n: Column) -> Column:
    """A number in [0, n) from an MD5, the same in any engine that has it."""
    return F.pmod(hashed(seed, draw, block), n)


def hashed(seed: int, draw: Column, block: Column) -> Column:
    digest = F.md5(F.concat_ws(":", F.lit(seed), draw, block))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def block_bootstrap(rows: DataFrame, value: Column, unit: str, block: int, seed: int = 0, draws: int = DRAWS) -> DataFrame:
    """One row: lo, hi, the 5% and 95% points of the mean over draws of blocks of `block` units.

    Rows are summed up per unit (a date, a year) first, so the draws' size depends on the number
    of units alone. Fewer than two blocks of units give nulls.
    """
    spark = rows.sparkSession
    units = rows.groupBy(F.col(unit).alias("unit")).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))
    units = hold(units)  # one row per calendar unit, read twice
    order = Window.partitionBy(F.lit(0)).orderBy("unit")  # one row per calendar unit
    ahead = order.rowsBetween(0, block - 1)
    blocks = units.select((F.row_number().over(order) - 1).alias("start"), F.sum("s").over(ahead).alias("s"), F.sum("n").over(ahead).alias("n"))
    size = blocks.agg(F.count(F.lit(1)).alias("units"))
    size = size.withColumns({"starts": F.col("units") - block + 1, "blocks": F.ceil(F.col("units") / block)})
    picks = spark.range(draws).withColumnRenamed("id", "draw").join(F.broadcast(size)).filter(F.col("units") >= 2 * block)
    picks = picks.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    picks = picks.select("draw", hashed_start(seed, F.col("draw"), F.col("j"), F.col("starts")).alias("start"))
    means = picks.join(F.broadcast(blocks), "start").groupBy("draw").agg((F.sum("s") / F.sum("n")).alias("mean"))
    return means.agg(F.percentile("mean", F.lit(0.05)).alias("lo"), F.percentile("mean", F.lit(0.95)).alias("hi"))


def block_bootstrap_by(rows: DataFrame, value: Column, unit: str, block: int, key: str, seed: int = 0, draws: int = DRAWS) -> DataFrame:
    """key, lo, hi: `block_bootstrap` within each key; keys with fewer than two blocks of units are left out.

    A key's sums per unit (one per date) are one array, on which all its draws are made in place. The draws' hashes
    depend on draw and block alone, so they are made once, as one row with a number for each draw and block of the longest key.
    """
    units = rows.groupBy(key, F.col(unit).alias("unit")).agg(F.sum(value).alias("s"), F.count(F.lit(1)).cast("double").alias("n"))
    order = Window.partitionBy(key).orderBy("unit")
    ahead = order.rowsBetween(0, block - 1)
    blocks = units.select(key, (F.row_number().over(order) - 1).alias("start"), F.sum("s").over(ahead).alias("s"), F.sum("n").over(ahead).alias("n"))
    lists = blocks.groupBy(key).agg(F.count(F.lit(1)).alias("units"), F.sort_array(F.collect_list(F.struct("start", "s", "n"))).alias("all")).filter(F.col("units") >= 2 * block)
    lists = hold(lists.withColumn("blocks", F.ceil(F.col("units") / block).cast("int")))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    hashes = F.transform(upto(F.lit(draws)), lambda d: F.transform(upto(F.col("most")), lambda j: hashed(seed, d, j)))
    drawn = lists.agg(F.max("blocks").alias("most")).filter("most is not null").select(hashes.alias("hashes"))  # one row
    start = lambda h: F.pmod(h, F.col("units") - block + 1).cast("int")
    picked = lambda row: F.transform(F.slice(row, F.lit(1), F.col("blocks")), lambda h: F.get("all", start(h)))
    none = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("n"))
    add = lambda acc, x: F.struct((acc["s"] + x["s"]).alias("s"), (acc["n"] + x["n"]).alias("n"))
    each = F.transform("hashes", lambda row: F.aggregate(picked(row), none, add, lambda acc: acc["s"] / acc["n"]))
    means = lists.join(F.broadcast(drawn)).select(key, F.sort_array(each).alias("means"))
    return means.select(key, _point("means", 0.05, draws).alias("lo"), _point("means", 0.95, draws).alias("hi"))


def _point(values: str, share: float, n: int) -> Column:
    """The percentile of n sorted values, between neighbours in proportion."""
    at = (n - 1) * share
    low, high = int(at), min(int(at) + 1, n - 1)
    return F.get(values, F.lit(low)) * (1 - (at - low)) + F.get(values, F.lit(high)) * (at - low)


def calibration(rows: DataFrame, predicted: str, happened: Column, bins: int = 5) -> DataFrame:
    """bin, predicted, realized, rows over quantile bins (lo, hi]; empty bins are left out.

    Predictions are a function of fit and state, so they have few distinct values and the exact
    quantiles are cheap.
    """
    edges = rows.agg(F.percentile(predicted, F.array(*[F.lit(k / bins) for k in range(bins + 1)])).alias("edges"))
    x = F.col(predicted)
    lo = lambda k: F.col("edges")[k] - (1e-9 if k == 0 else 0.0)
    hi = lambda k: F.col("edges")[k + 1] + (1e-9 if k == bins - 1 else 0.0)
    out = F.lit(None).cast("int")
    for k in range(bins - 1, -1, -1):
        out = F.when((x > lo(k)) & (x <= hi(k)), F.lit(k)).otherwise(out)
    placed = rows.join(F.broadcast(edges)).withColumn("bin", out).filter("bin is not null")
    return placed.groupBy("bin").agg(F.avg(predicted).alias("predicted"), F.avg(happened.cast("double")).alias("realized"), F.count(F.lit(1)).alias("rows"))


def auc(rows: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rank AUC for each of the keys, ties at their middle rank; null if a class is missing.

    `score` lies in [0, 1]. Rows are counted per distinct score, and these in narrow bins: whole
    bins below a score come from a small table, so no window holds more than the scores of one bin.
    """
    part = list(keys) or [F.lit(0)]
    y = F.col(label).cast("int")
    at = rows.filter(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("score")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    at = hold(at.withColumn("bin", F.floor(F.col("score") * BINS)))
    upto = lambda *order: F.coalesce(F.sum("neg").over(Window.partitionBy(*order[:-1]).orderBy(order[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = at.groupBy(*keys, "bin").agg(F.sum("neg").alias("neg")).select(*keys, "bin", upto(*part, "bin").alias("lower"))
    below = F.col("lower") + upto(*keys, "bin", "score")
    at = at.join(bins, [*keys, "bin"]).withColumn("won", F.col("pos") * (below + F.col("neg") / 2))
    out = at.groupBy(*keys).agg(F.sum("won").alias("won"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return out.select(*keys, "n_pos", "n_neg", F.try_divide(F.col("won"), F.col("n_pos") * F.col("n_neg")).alias("auc"))
