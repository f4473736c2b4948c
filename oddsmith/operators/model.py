"""State-conditional distribution of the forward return, as long tables.

`keys` are extra grouping columns (none, a fit number, a ticker, ...): one call fits all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oddsmith.config import Config
from oddsmith.functions.columns import bucket, literal_table
from oddsmith.operators.factors import states


def state_table(spark: SparkSession, cfg: Config) -> DataFrame:
    return literal_table(spark, list(enumerate(states(cfg))), "state_id int, state string")


def bucket_label(lo: float | None, hi: float | None) -> str:
    if lo is None or hi is None:
        return f"below {hi:+.0%}" if lo is None else f"above {lo:+.0%}"
    return f"{lo:+.0%} to {hi:+.0%}"


def bucket_table(spark: SparkSession, cfg: Config) -> DataFrame:
    """bucket, lo, hi (relative moves; null at the open ends), is_up, label."""
    bounds = [None, *cfg.edges, None]
    rows = [(k, lo, hi, k > 0 and lo >= 0, bucket_label(lo, hi)) for k, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))]
    return literal_table(spark, rows, "bucket int, lo double, hi double, is_up boolean, label string")


def with_bucket(rows: DataFrame, cfg: Config) -> DataFrame:
    return rows.withColumn("bucket", bucket(F.col("fwd_ret"), cfg.edges))


def deltas(rows: DataFrame, cfg: Config, keys: Sequence[str] = ()) -> DataFrame:
    """n, sum_r, sum_r2 of each (keys, state, bucket) that occurs."""
    r = F.col("fwd_ret")
    return with_bucket(rows, cfg).groupBy(*keys, "state", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(r).alias("sum_r"), F.sum(r * r).alias("sum_r2"))


def grid(spark: SparkSession, cfg: Config) -> DataFrame:
    """Every state with every bucket: a fixed, small table."""
    return state_table(spark, cfg).crossJoin(bucket_table(spark, cfg))


def counted(rows: DataFrame, cfg: Config, keys: Sequence[str] = ()) -> DataFrame:
    """`deltas` on the dense grid of states and buckets, for each of the keys that occur."""
    spark = rows.sparkSession
    found = deltas(rows, cfg, keys)
    cells = F.broadcast(grid(spark, cfg).select("state_id", "state", "bucket", "is_up"))
    dense = found.select(*keys).distinct().join(cells) if keys else cells
    filled = dense.join(found, [*keys, "state", "bucket"], "left")
    return filled.withColumns({"n": F.coalesce("n", F.lit(0)), "sum_r": F.coalesce("sum_r", F.lit(0.0)), "sum_r2": F.coalesce("sum_r2", F.lit(0.0))})


def shrunk(cells: DataFrame, cfg: Config, cluster: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Adds the unconditional q, the weight w, p and the shrunk moments m, m2 to dense cells.

    p = w emp + (1 - w) q with w = n_eff / (n_eff + prior_strength), n_eff the state's rows over
    horizon times cluster; a state without rows has p = q, an empty cell the bucket's own moments.
    """
    by_bucket, by_state, by_all = (Window.partitionBy(*keys, *c) for c in (("bucket",), ("state",), ()))
    if not keys:
        by_all = Window.partitionBy(F.lit(0))  # the grid alone: as many rows as states times buckets
    out = cells.withColumns(
        {
            "n_bucket": F.sum("n").over(by_bucket),
            "n_state": F.sum("n").over(by_state),
            "n_all": F.sum("n").over(by_all),
            "r_bucket": F.sum("sum_r").over(by_bucket),
            "r2_bucket": F.sum("sum_r2").over(by_bucket),
        }
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = out.withColumns(
        {
            "q": zero(F.try_divide("n_bucket", "n_all")),
            "m_bucket": zero(F.try_divide("r_bucket", "n_bucket")),
            "m2_bucket": zero(F.try_divide("r2_bucket", "n_bucket")),
            "n_eff": F.col("n_state") / (cfg.horizon * cluster),
        }
    )
    out = out.withColumn("w", F.col("n_eff") / (F.col("n_eff") + cfg.prior_strength))
    mixed = lambda own, base: F.col("w") * F.coalesce(own, F.col(base)) + (1 - F.col("w")) * F.col(base)
    return out.withColumns(
        {
            "p": mixed(F.try_divide("n", "n_state"), "q"),
            "m": mixed(F.try_divide("sum_r", "n"), "m_bucket"),
            "m2": mixed(F.try_divide("sum_r2", "n"), "m2_bucket"),
        }
    )


def moments(model: DataFrame, keys: Sequence[str] = (), arrays: bool = False) -> DataFrame:
    """One row per (keys, state): p_up, ev, std, Kelly figures, and the same of the baseline.

    `arrays` adds the distributions by bucket: probs, baseline, bucket_mean.
    """
    up = lambda c: F.sum(F.when(F.col("is_up"), F.col(c)).otherwise(0.0))
    out = model.groupBy(*keys, "state_id", "state").agg(
        F.max("n_state").alias("n_rows"),
        F.max("n_eff").alias("n_eff"),
        F.max("w").alias("w"),
        up("p").alias("p_up"),
        up("q").alias("p_up_base"),
        F.sum(F.col("p") * F.col("m")).alias("ev"),
        F.sum(F.col("p") * F.col("m2")).alias("__m2"),
        F.sum(F.col("q") * F.col("m_bucket")).alias("ev_base"),
        F.sum(F.col("p") * F.col("p")).alias("p2"),
        F.sum(F.col("q") * F.col("q")).alias("q2"),
        F.sum(F.col("q") * F.col("m2_bucket")).alias("__m2_base"),
        *([F.sort_array(F.collect_list(F.struct("bucket", "p", "q", "m"))).alias("__cells")] if arrays else []),
    )
    if arrays:
        cells = F.col("__cells")
        out = out.withColumns({"probs": cells["p"], "baseline": cells["q"], "bucket_mean": cells["m"]}).drop("__cells")
    for ev, second, end in (("ev", "__m2", ""), ("ev_base", "__m2_base", "_base")):
        variance = F.greatest(F.col(second) - F.col(ev) * F.col(ev), F.lit(1e-12))
        out = out.withColumns({f"std{end}": F.sqrt(variance), f"kelly_full{end}": F.col(ev) / variance})
        out = out.withColumns({f"ev_over_std{end}": F.col(ev) / F.col(f"std{end}"), f"kelly_half{end}": F.col(f"kelly_full{end}") / 2})
    return out.drop("__m2", "__m2_base")


def cluster_factor(feat: DataFrame, cfg: Config) -> DataFrame:
    """One row: rows per date (at least 1, and 1 in relative mode), usable rows, independent rows."""
    per_date = feat.groupBy("date").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.expr("state is not null and fwd_ret is not null")).alias("usable"))
    cluster = F.lit(1.0) if cfg.relative else F.greatest(F.lit(1.0), F.avg("rows"))
    out = per_date.agg(cluster.alias("cluster"), F.sum("usable").alias("usable_rows"))
    return out.withColumn("independent", F.col("usable_rows") / (cfg.horizon * F.col("cluster")))


def fitted(feat: DataFrame, cfg: Config, keys: Sequence[str] = ()) -> DataFrame:
    """The model over all usable rows: pooled, or one for each of the keys (with cluster 1)."""
    cells = counted(usable_rows(feat), cfg, keys)
    if keys:
        return shrunk(cells, cfg, F.lit(1.0), keys)
    one = cluster_factor(feat, cfg).select("cluster")  # one row
    return shrunk(cells.join(F.broadcast(one)), cfg, F.col("cluster"))


def usable_rows(feat: DataFrame) -> DataFrame:
    return feat.filter("state is not null and fwd_ret is not null")


def predictions(fitted: DataFrame, keys: Sequence[str] = (), whole: bool = False) -> DataFrame:
    """What the model says of each (keys, state): rows, independent observations, weight, p_up and the moments.

    `whole` adds the moments of the baseline and the distributions by bucket.
    """
    columns = ["p_up", "p_up_base", "ev", "ev_base", "std", "ev_over_std", "kelly_full", "kelly_half"]
    if whole:
        columns += ["std_base", "ev_over_std_base", "kelly_full_base", "kelly_half_base", "probs", "baseline", "bucket_mean"]
    return moments(fitted, keys, whole).select(*keys, "state", "n_rows", F.round("n_eff", 1).alias("independent_obs"), F.round("w", 3).alias("weight_on_state"), *columns)


def transitions(feat: DataFrame, cfg: Config, keys: Sequence[str] = ()) -> DataFrame:
    """from_state, to_state, n, p: the state `horizon` usable rows later within the ticker, shrunk to the destinations' shares.

    With keys (the ticker) there is one matrix for each of them, with cluster 1.
    """
    rows = usable_rows(feat)
    ahead = F.lead("state", cfg.horizon).over(Window.partitionBy("ticker").orderBy("date"))
    pairs = rows.select(*keys, F.col("state").alias("from_state"), ahead.alias("to_state")).filter("to_state is not null").groupBy(*keys, "from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))
    names = state_table(rows.sparkSession, cfg)
    dense = names.select(F.col("state").alias("from_state")).crossJoin(names.select(F.col("state").alias("to_state")))
    dense = rows.select(*keys).distinct().join(F.broadcast(dense)) if keys else dense
    cells = dense.join(pairs, [*keys, "from_state", "to_state"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    cells = cells.withColumn("cluster", F.lit(1.0)) if keys else cells.join(F.broadcast(cluster_factor(feat, cfg).select("cluster")))
    size = len(states(cfg))
    whole, origin, target = (Window.partitionBy(*(list(keys) + c or [F.lit(0)])) for c in ([], ["from_state"], ["to_state"]))
    cells = cells.withColumn("share", F.coalesce(F.try_divide(F.sum("n").over(target), F.sum("n").over(whole)), F.lit(1 / size)))
    n = F.sum("n").over(origin)
    eff = n / (cfg.horizon * F.col("cluster"))
    w = eff / (eff + cfg.prior_strength)
    return cells.withColumn("p", w * F.coalesce(F.try_divide(F.col("n"), n), F.col("share")) + (1 - w) * F.col("share")).select(*keys, "from_state", "to_state", "n", "p")
