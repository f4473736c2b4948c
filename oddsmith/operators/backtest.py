"""Purged, expanding walk-forward in one pass: fits are cumulative sums over the refit calendar."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oddsmith.config import Config
from oddsmith.functions.columns import brier, business_days_ahead, log_loss
from oddsmith.functions.held import hold
from oddsmith.operators import model, sparse


def refit_calendar(feat: DataFrame, cfg: Config, keys: Sequence[str] = (), every: int | None = None) -> DataFrame:
    """fit_id, refit_date: each n-th distinct date from the end of the first training years on.

    Without keys the calendar is one small sequence of dates; with keys it is one for each key.
    """
    part = list(keys) or [F.lit(0)]
    days = feat.select(*keys, "date").distinct()
    order = Window.partitionBy(*part).orderBy("date")
    days = days.withColumns({"__n": F.row_number().over(order) - 1, "__first": F.min("date").over(Window.partitionBy(*part))})
    start = F.date_add("__first", int(cfg.min_train_years * 365))
    picked = days.filter((F.col("__n") % (every or cfg.refit_every) == 0) & (F.col("date") >= start))
    return picked.select(*keys, (F.row_number().over(order) - 1).alias("fit_id"), F.col("date").alias("refit_date"))


def dated_fits(feat: DataFrame, cfg: Config, keys: Sequence[str] = (), every: int | None = None) -> DataFrame:
    """For every date: test_fit, the last refit on or before it; train_fit, the first refit by which
    its outcome is known (date + horizon in business days). Either may be null."""
    part = list(keys) or [F.lit(0)]
    fits = refit_calendar(feat, cfg, keys, every)
    days = feat.select(*keys, "date").distinct()
    # One ordered column of days holds refits, dates and purge dates: as-of without a range join.
    known = business_days_ahead(F.col("date"), cfg.horizon)
    refits = fits.select(*keys, F.col("refit_date").alias("day"), "fit_id", F.lit(None).cast("date").alias("date"), F.lit(0).alias("kind"))
    tests = days.select(*keys, F.col("date").alias("day"), F.lit(None).cast("int").alias("fit_id"), "date", F.lit(1).alias("kind"))
    purged = days.select(*keys, known.alias("day"), F.lit(None).cast("int").alias("fit_id"), "date", F.lit(2).alias("kind"))
    line = refits.unionByName(tests).unionByName(purged).withColumn("__day", F.unix_date("day"))
    upto = Window.partitionBy(*part).orderBy("__day").rangeBetween(Window.unboundedPreceding, 0)
    since = Window.partitionBy(*part).orderBy("__day").rangeBetween(0, Window.unboundedFollowing)
    line = line.withColumns({"__test": F.max("fit_id").over(upto), "__train": F.min("fit_id").over(since)}).filter("kind > 0")
    return line.groupBy(*keys, "date").agg(F.max(F.when(F.col("kind") == 1, F.col("__test"))).alias("test_fit"), F.max(F.when(F.col("kind") == 2, F.col("__train"))).alias("train_fit"))


def attached(feat: DataFrame, cfg: Config, keys: Sequence[str] = (), every: int | None = None) -> DataFrame:
    """Usable rows with their test_fit and train_fit."""
    if keys:
        return model.usable_rows(_fits_along(feat, cfg, keys, every))
    # Without keys the calendar has a row per calendar day, which bounds the broadcast.
    return model.usable_rows(feat).join(F.broadcast(hold(dated_fits(feat, cfg, keys, every))), "date")


def _fits_along(feat: DataFrame, cfg: Config, keys: Sequence[str], every: int | None) -> DataFrame:
    """`feat` with the fits of `dated_fits`, by windows along the dates of each key: no join, one partitioning.

    A refit counts for a date's training from the day on which its outcome is known. That day lies as many calendar
    days ahead as the weekday says, so there are a few frames that reach ahead by a fixed number of days.
    """
    n = cfg.horizon
    ahead = sorted({n + 2 * ((min(d, 4) + n) // 5) - max(d - 4, 0) for d in range(7)})
    whole, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("__day")
    rows = feat.filter("date is not null").withColumn("__day", F.unix_date("date"))
    rows = rows.withColumns({"__n": F.dense_rank().over(order) - 1, "__again": F.lag("__day").over(order).eqNullSafe(F.col("__day")), "__first": F.min("date").over(whole)})
    start = F.date_add("__first", int(cfg.min_train_years * 365))
    rows = rows.withColumn("__refit", (~F.col("__again") & (F.col("__n") % (every or cfg.refit_every) == 0) & (F.col("date") >= start)).cast("int"))
    refits = lambda upto: F.sum("__refit").over(order.rangeBetween(Window.unboundedPreceding, upto))
    rows = rows.withColumns({"__upto": refits(0), "__total": F.sum("__refit").over(whole), **{f"__before{k}": refits(k - 1) for k in ahead}})
    days = F.datediff(business_days_ahead(F.col("date"), n), "date")
    before = F.coalesce(*[F.when(days == k, F.col(f"__before{k}")) for k in ahead])  # refits before the outcome is known
    rows = rows.withColumns({"test_fit": F.when(F.col("__upto") > 0, F.col("__upto") - 1).cast("int"), "train_fit": F.when(before < F.col("__total"), before).cast("int")})
    return rows.drop(*[c for c in rows.columns if c.startswith("__")])


def expanding_fits(rows: DataFrame, cfg: Config) -> DataFrame:
    """Cumulative cells of every fit from `attached` rows; fits that have seen fewer than two states are left out."""
    found = model.deltas(rows.filter("train_fit is not null"), cfg, ["train_fit"])
    ids = rows.select(F.col("test_fit").alias("fit_id")).unionByName(rows.select(F.col("train_fit").alias("fit_id"))).filter("fit_id is not null").distinct()
    dense = ids.join(F.broadcast(model.grid(rows.sparkSession, cfg).select("state_id", "state", "bucket", "is_up")))
    cells = dense.join(found.withColumnRenamed("train_fit", "fit_id"), ["fit_id", "state", "bucket"], "left")
    upto = Window.partitionBy("state", "bucket").orderBy("fit_id").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumns({c: F.coalesce(F.sum(c).over(upto), F.lit(0)) for c in ("n", "sum_r", "sum_r2")})
    by_state = Window.partitionBy("fit_id", "state")
    cells = cells.withColumn("__seen", (F.sum("n").over(by_state) > 0).cast("int") / F.count(F.lit(1)).over(by_state))
    cells = cells.withColumn("n_seen", F.round(F.sum("__seen").over(Window.partitionBy("fit_id"))).cast("int"))
    return cells.filter("n_seen >= 2").drop("__seen")


SCORED_FROM = ("ticker", "date", "state", "fwd_ret")


def scored(feat: DataFrame, cfg: Config, keys: Sequence[str] = (), every: int | None = None) -> DataFrame:
    """Every scored row with losses of model and baseline and its period (dev or holdout).

    The features enter several small tables (calendar, cells, cluster) and the scoring join, so
    what these read of them is held here, once. Joining the calendar again is cheaper than holding its outcome.
    """
    needed = dict.fromkeys([*keys, *SCORED_FROM])
    feat = hold(feat if set(feat.columns) == set(needed) else feat.select(*needed))
    rows = attached(feat, cfg, keys, every)
    if keys:
        rows = hold(rows)
        return sparse.with_period(_losses(sparse.scored(rows, cfg, keys)), cfg.holdout_fraction, keys)
    cells = expanding_fits(rows, cfg)
    one = model.cluster_factor(feat, cfg).select("cluster")
    fitted = model.shrunk(cells.join(F.broadcast(one)), cfg, F.col("cluster"), ["fit_id"])
    fitted = hold(fitted)  # fits x states x buckets, read three times
    tests = model.with_bucket(rows, cfg).filter("test_fit is not null").withColumnRenamed("test_fit", "fit_id")
    # Which rows get a score depends on the fits alone, so the cut needs no scores.
    cut = holdout_cut(tests.join(fitted.select("fit_id").distinct(), "fit_id", "left_semi"), cfg.holdout_fraction)
    per_cell = fitted.select("fit_id", "state", "bucket", "p", "q")
    per_state = model.moments(fitted, ["fit_id"]).select("fit_id", "state", "p_up", "p_up_base", "ev", "ev_base", "p2", "q2")
    out = tests.join(F.broadcast(per_cell), ["fit_id", "state", "bucket"]).join(F.broadcast(per_state), ["fit_id", "state"])  # fits x states x buckets
    return _with_period(_losses(out), cut)


def _losses(rows: DataFrame) -> DataFrame:
    return rows.select(
        "date",
        "ticker",
        "fit_id",
        "state",
        "bucket",
        log_loss(F.col("p")).alias("ll_model"),
        log_loss(F.col("q")).alias("ll_base"),
        brier(F.col("p2"), F.col("p")).alias("brier_model"),
        brier(F.col("q2"), F.col("q")).alias("brier_base"),
        F.col("p_up").alias("p_up_model"),
        "p_up_base",
        (F.col("fwd_ret") > 0).alias("went_up"),
        F.col("ev").alias("ev_model"),
        "ev_base",
        F.col("fwd_ret").alias("realized"),
    )


def holdout_cut(rows: DataFrame, fraction: float) -> DataFrame:
    """cut, a date: all rows from it on are the holdout.

    It is the date of the row at position floor(n (1 - fraction)) in date order, found from counts per date.
    """
    days = rows.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(F.lit(0))  # one row per calendar day
    days = days.withColumns({"upto": F.sum("n").over(whole.orderBy("date")), "total": F.sum("n").over(whole)})
    return days.filter(F.col("upto") > F.floor(F.col("total") * (1 - fraction))).agg(F.min("date").alias("cut"))


def _with_period(rows: DataFrame, cut: DataFrame) -> DataFrame:
    rows = rows.join(F.broadcast(cut))
    return rows.withColumn("period", F.when(F.col("date") < F.col("cut"), "dev").otherwise("holdout")).drop("cut")


def summary(rows: DataFrame, cfg: Config, cluster: DataFrame, unlocked: bool = False) -> DataFrame:
    """One row per period; a locked holdout shows only how many rows it has, and from when to when."""
    hit = lambda p: F.avg(((F.round(p, 9) > 0.5) == F.col("went_up")).cast("double"))
    out = rows.groupBy("period").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("date").alias("start"),
        F.max("date").alias("end"),
        F.avg("ll_model").alias("logloss_model"),
        F.avg("ll_base").alias("logloss_base"),
        F.avg(F.col("ll_base") - F.col("ll_model")).alias("logloss_gain"),
        F.avg("brier_model").alias("brier_model"),
        F.avg("brier_base").alias("brier_base"),
        hit("p_up_model").alias("hit_model"),
        hit("p_up_base").alias("hit_base"),
    )
    out = out.join(F.broadcast(cluster.select("cluster"))).withColumn("independent", F.col("rows") / (cfg.horizon * F.col("cluster"))).drop("cluster")
    if unlocked:
        return out
    hidden = [c for c in out.columns if c not in ("period", "rows", "start", "end")]
    return out.withColumns({c: F.when(F.col("period") == "dev", F.col(c)) for c in hidden})


def track_record(rows: DataFrame, cfg: Config) -> DataFrame:
    """Every horizon-th scored row of each ticker: what was expected, and what came."""
    nth = F.row_number().over(Window.partitionBy("ticker").orderBy("date")) - 1
    picked = rows.withColumn("__n", nth).filter(F.col("__n") % cfg.horizon == 0)
    return picked.select("ticker", "date", "state", "ev_model", "ev_base", "realized", ((F.col("ev_model") > 0) == (F.col("realized") > 0)).alias("hit"), "period")


def track_record_summary(track: DataFrame) -> DataFrame:
    """One row per ticker over its dev rows; the hit rates of an empty side are null."""
    up = F.col("realized") > 0
    rate = lambda c: F.avg(c.cast("double"))
    return track.filter("period = 'dev'").groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("ev_model") > 0).alias("n_positive"),
        rate(F.col("hit")).alias("hit_rate"),
        rate(F.when(F.col("ev_model") > 0, F.col("hit"))).alias("hit_when_positive"),
        rate(F.when(F.col("ev_model") <= 0, F.col("hit"))).alias("hit_when_negative"),
        rate((F.col("ev_base") > 0) == up).alias("base_hit_rate"),
        rate(up).alias("always_up_rate"),
    )
