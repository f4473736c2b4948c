"""Walk-forward of one model per key, kept as change points.

A state's counts change only at the fits at which new rows of it become known. Each such change is
one row with the cumulated counts of all buckets; a test row looks up the last change at or before
its fit. So there are as many rows as there are changes, never a grid of keys, fits, states and
buckets, and all of it happens in one partitioning by key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oddsmith.config import Config
from oddsmith.operators import model


def _each(cfg: Config, part: str) -> list[str]:
    return [f"{part}{k}" for k in range(len(cfg.edges) + 1)]


def change_points(rows: DataFrame, cfg: Config, keys: Sequence[str]) -> DataFrame:
    """(keys, state, fit_id): n0.. rows and r0.. sums of returns by bucket of all rows known at that fit.

    There is a row for each fit at which the state gains training rows. `is_new` marks a state's first.
    """
    found = model.with_bucket(rows.filter("train_fit is not null"), cfg)
    inside = [F.col("bucket") == k for k in range(len(cfg.edges) + 1)]
    counts = [F.count_if(here).alias(n) for here, n in zip(inside, _each(cfg, "n"), strict=True)]
    sums = [F.sum(F.when(here, F.col("fwd_ret")).otherwise(0.0)).alias(r) for here, r in zip(inside, _each(cfg, "r"), strict=True)]
    gained = found.groupBy(*keys, "state", F.col("train_fit").alias("fit_id")).agg(*counts, *sums)
    order = Window.partitionBy(*keys, "state").orderBy("fit_id")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    totals = {c: F.sum(c).over(upto) for part in "nr" for c in _each(cfg, part)}
    return gained.select(*keys, "state", "fit_id", *[x.alias(c) for c, x in totals.items()], (F.row_number().over(order) == 1).alias("is_new"), *[F.col(c).alias(f"gain_{c}") for c in totals])


def key_totals(changes: DataFrame, cfg: Config, keys: Sequence[str]) -> DataFrame:
    """(keys, fit_id): the same over all states, and n_seen, the states seen so far."""
    names = [c for part in "nr" for c in _each(cfg, part)]
    gained = changes.groupBy(*keys, "fit_id").agg(*[F.sum(f"gain_{c}").alias(c) for c in names], F.count_if("is_new").alias("n_seen"))
    upto = Window.partitionBy(*keys).orderBy("fit_id").rowsBetween(Window.unboundedPreceding, 0)
    return gained.select(*keys, "fit_id", *[F.sum(c).over(upto).alias(c) for c in (*names, "n_seen")])


def looked_up(tests: DataFrame, changes: DataFrame, cfg: Config, keys: Sequence[str]) -> DataFrame:
    """`tests` (keys, fit_id, state, ...) with `all`, the totals of the key, and `own`, those of the state, at the fit.

    Both are null where nothing is known yet. Changes and tests share one ordered column: the last
    change so far is the one in force.
    """
    names = [c for part in "nr" for c in _each(cfg, part)]
    total = key_totals(changes, cfg, keys)
    all_ = F.struct(*names, "n_seen")
    own = F.struct(*names)
    test = F.struct(*[c for c in tests.columns if c not in (*keys, "state", "fit_id")])
    none = F.lit(None).cast("string")
    line = tests.select(*keys, "state", "fit_id", F.lit(1).alias("kind"), test.alias("test"))
    line = line.unionByName(total.select(*keys, none.alias("state"), "fit_id", F.lit(0).alias("kind"), all_.alias("all")), allowMissingColumns=True)
    line = line.unionByName(changes.select(*keys, "state", "fit_id", F.lit(0).alias("kind"), own.alias("own")), allowMissingColumns=True)
    far = lambda *by: Window.partitionBy(*by).orderBy("fit_id", "kind").rowsBetween(Window.unboundedPreceding, 0)
    line = line.withColumn("all", F.last("all", ignorenulls=True).over(far(*keys)))
    line = line.withColumn("own", F.last("own", ignorenulls=True).over(far(*keys, "state")))
    return line.filter("kind = 1").select(*keys, "state", "fit_id", "test.*", "all", "own")


def scored(rows: DataFrame, cfg: Config, keys: Sequence[str]) -> DataFrame:
    """Test rows of `rows` (from `backtest.attached`) with p and q of their bucket and what else the losses need.

    Fits that have seen fewer than two states score nothing; a state that is not seen yet has p = q.
    Models are looked up and worked out once for each key, fit and state that is tested, not for each row.
    """
    changes = change_points(rows, cfg, keys)
    tests = model.with_bucket(rows, cfg).filter("test_fit is not null").withColumnRenamed("test_fit", "fit_id").drop("train_fit")
    asked = tests.select(*keys, "state", "fit_id").distinct()
    fitted = _fitted(looked_up(asked.withColumn("asked", F.lit(True)), changes, cfg, keys).filter(F.col("all.n_seen") >= 2).drop("asked"), cfg)
    at = lambda part: F.element_at(f"{part}s", F.col("bucket") + 1)
    return tests.join(fitted, [*keys, "state", "fit_id"]).withColumns({"p": at("p"), "q": at("q")}).drop("ps", "qs")


def _fitted(out: DataFrame, cfg: Config) -> DataFrame:
    """`looked_up` rows with the distributions by bucket (ps, qs) and what the losses need of them."""
    size = range(len(cfg.edges) + 1)
    up = [k > 0 and cfg.edges[k - 1] >= 0 for k in size]
    added = lambda columns: sum(columns[1:], columns[0])
    own = lambda c: F.coalesce(F.col(f"own.{c}"), F.lit(0))
    out = out.withColumns({"n_all": added([F.col(f"all.n{k}") for k in size]), "n_state": added([own(f"n{k}") for k in size])})
    out = out.withColumn("n_eff", F.col("n_state") / F.lit(float(cfg.horizon)))
    out = out.withColumn("w", F.col("n_eff") / (F.col("n_eff") + cfg.prior_strength))
    mixed = lambda mine, base: F.col("w") * F.coalesce(mine, base) + (1 - F.col("w")) * base
    base: dict[str, Column] = {}
    for k in size:
        base[f"q_{k}"] = F.col(f"all.n{k}") / F.col("n_all")
        base[f"b_{k}"] = F.coalesce(F.try_divide(f"all.r{k}", f"all.n{k}"), F.lit(0.0))
    out = out.withColumns(base)
    fitted: dict[str, Column] = {}
    for k in size:
        fitted[f"p_{k}"] = mixed(F.try_divide(own(f"n{k}"), "n_state"), F.col(f"q_{k}"))
        fitted[f"m_{k}"] = mixed(F.try_divide(f"own.r{k}", f"own.n{k}"), F.col(f"b_{k}"))
    out = out.withColumns(fitted)
    each = lambda part: F.array(*[F.col(f"{part}_{k}") for k in size])
    product = lambda a, b: added([F.col(f"{a}_{k}") * F.col(f"{b}_{k}") for k in size])
    rising = lambda part: added([F.col(f"{part}_{k}") for k in size if up[k]] or [F.lit(0.0)])
    return out.withColumns(
        {
            "ps": each("p"), "qs": each("q"), "p_up": rising("p"), "p_up_base": rising("q"), "ev": product("p", "m"), "ev_base": product("q", "b"), "p2": product("p", "p"), "q2": product("q", "q"),
        }
    ).drop(*base, *fitted, "all", "own", "n_all", "n_state", "n_eff", "w")


def with_period(rows: DataFrame, fraction: float, keys: Sequence[str]) -> DataFrame:
    """Adds `period`: holdout from the date on that the row at position floor(n (1 - fraction)) of its key has."""
    of_key = Window.partitionBy(*keys)
    upto = F.count(F.lit(1)).over(of_key.orderBy("date").rangeBetween(Window.unboundedPreceding, 0))
    marked = rows.withColumns({"__upto": upto, "__total": F.count(F.lit(1)).over(of_key)})
    cut = F.min(F.when(F.col("__upto") > F.floor(F.col("__total") * (1 - fraction)), F.col("date"))).over(of_key)
    marked = marked.withColumn("__cut", cut)
    return marked.withColumn("period", F.when(F.col("date") < F.col("__cut"), "dev").otherwise("holdout")).drop("__upto", "__total", "__cut")
