"""Jobs over the whole set of tickers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oddsmith.config import Config
from oddsmith.functions.columns import clean, verdict
from oddsmith.functions.held import hold
from oddsmith.operators import backtest, model, resample
from oddsmith.operators.windows import along, newest


def with_history(prices: DataFrame, least_rows: int) -> DataFrame:
    """Rows of the tickers that have at least `least_rows` of them."""
    n = F.count(F.lit(1)).over(Window.partitionBy("ticker"))
    return prices.withColumn("n_rows", n).filter(F.col("n_rows") >= least_rows).drop("n_rows")


def alive_by_year(meta: DataFrame) -> DataFrame:
    """Tickers alive in each calendar year from their first to their last price."""
    years = meta.select(F.explode(F.sequence(F.year("first"), F.year("last"))).alias("year"))
    return years.groupBy("year").agg(F.count(F.lit(1)).alias("alive"))


def equal_weight_index(prices: DataFrame, pad_dead: bool = False) -> DataFrame:
    """date, ret, level: mean daily return across tickers, and 100 times its compounded sum.

    Only tickers with a price on the day and one before count; `pad_dead` counts every ticker
    from its first return on, with 0 where it has no price.
    """
    ret = F.try_divide(F.col("close"), F.lag("close", 1).over(along())) - 1
    rets = prices.withColumn("ret", ret).filter("ret is not null")
    days = rets.groupBy("date").agg(F.sum("ret").alias("total"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(F.lit(0)).orderBy("date")  # one row per calendar day
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    if pad_dead:
        begun = rets.groupBy("ticker").agg(F.min("date").alias("date")).groupBy("date").agg(F.count(F.lit(1)).alias("new"))
        days = days.join(begun, "date", "left").withColumn("n", F.sum(F.coalesce("new", F.lit(0))).over(upto))
    days = days.withColumn("ret", F.col("total") / F.col("n"))
    return days.select("date", "ret", (100 * F.exp(F.sum(F.log1p("ret")).over(upto))).alias("level"))


def latest_rows(feat: DataFrame) -> DataFrame:
    """The last row of each ticker."""
    last = F.max_by(F.struct(*feat.columns), "date").alias("last")
    return feat.groupBy("ticker").agg(last).select("last.*")


SPANS = (1, 21, 252)
TOO_SHORT = "too little history for a walk-forward of its own"


def recent(prices: DataFrame, history: int = 756, vol: int = 252, spans: tuple[int, ...] = SPANS) -> DataFrame:
    """One row per ticker from its newest rows alone: what `lookbacks`, `annualised_vol` and `recent_history` give.

    All of it comes out of one exchange of at most as many rows a ticker and task as the longest of these needs.
    """
    rows = newest(prices.select("ticker", "date", "close"), max(history, vol + 1, *(n + 1 for n in spans)))
    rows = rows.withColumn("r", F.ln("close") - F.ln(F.lead("close", 1).over(Window.partitionBy("ticker").orderBy(F.desc("date")))))
    at = lambda n: F.max(F.when(F.col("nth") == n + 1, F.col("close")))
    held = lambda c: F.when(F.col("nth") <= history, c)
    return rows.groupBy("ticker").agg(
        F.max("date").alias("date"),
        at(0).alias("close"),
        *[(F.try_divide(at(0), at(n)) - 1).alias(f"change_{n}") for n in spans],
        (F.stddev_samp(F.when(F.col("nth") <= vol, F.col("r"))) * F.sqrt(F.lit(252.0))).alias("vol"),
        F.count(held(F.lit(1))).alias("n_days"),
        F.min(held(F.col("close"))).alias("low"),
        F.max(held(F.col("close"))).alias("high"),
        F.sort_array(F.collect_list(held(F.struct("date", "close")))).alias("history"),
    )


def lookbacks(prices: DataFrame, spans: tuple[int, ...] = SPANS) -> DataFrame:
    """ticker, date, close and the change over each span of rows at the ticker's last row; null if too short."""
    return recent(prices, 1, 1, spans).select("ticker", "date", "close", *[f"change_{n}" for n in spans])


def annualised_vol(prices: DataFrame, n: int = 252) -> DataFrame:
    """ticker, vol: deviation of the last n log returns (or of fewer), per year."""
    return recent(prices, 1, n, (1,)).select("ticker", "vol")


def recent_history(prices: DataFrame, n: int = 756) -> DataFrame:
    """ticker, n_days, low, high, history: the last n (date, close), oldest first."""
    return recent(prices, n, 1, (1,)).select("ticker", "n_days", "low", "high", "history")


def survivorship_gap(feat: DataFrame, meta: DataFrame, cfg: Config) -> DataFrame:
    """cohort (all, survivors) and state: rows, p_up, ev. Survivors need more than 10 horizons of rows.

    Both cohorts are fitted with the cluster factor of the whole pool. `meta` has one row per ticker.
    """
    alive = meta.filter("fate = 'active'").select("ticker", F.lit(True).alias("active"))
    marked = feat.join(alive, "ticker", "left")
    both = marked.withColumn("cohort", F.explode(F.when(F.col("active"), F.array(F.lit("all"), F.lit("survivors"))).otherwise(F.array(F.lit("all")))))
    cluster = model.cluster_factor(feat, cfg).select("cluster")  # one row
    cells = model.counted(model.usable_rows(both), cfg, ["cohort"]).join(F.broadcast(cluster))
    out = model.moments(model.shrunk(cells, cfg, F.col("cluster"), ["cohort"]), ["cohort"])
    total = F.sum("n_rows").over(Window.partitionBy("cohort"))
    out = out.withColumn("total", total).filter((F.col("cohort") == "all") | (F.col("total") > 10 * cfg.horizon))
    return out.select("cohort", "state", "n_rows", "p_up", "ev", "p_up_base", "ev_base")


def focal_ticker(meta: DataFrame, wanted: str) -> DataFrame:
    """One row: the wanted ticker if it is known, or else the first active one by name."""
    named = F.max(F.when(F.col("ticker") == wanted, F.col("ticker")))
    return meta.agg(F.coalesce(named, F.min(F.when(F.col("fate") == "active", F.col("ticker")))).alias("ticker"))


def predicted(feat: DataFrame, fitted: DataFrame) -> DataFrame:
    """Each ticker's last row with what a pooled model says of its state, also of tickers outside the pool."""
    last = latest_rows(feat.select("ticker", "date", "state"))
    return last.join(F.broadcast(model.predictions(fitted)), "state")  # one row per state


def with_usable(feat: DataFrame, least_usable: int = 300) -> DataFrame:
    """Rows of the tickers with enough usable rows and a state on their last row."""
    good = feat.groupBy("ticker").agg(F.count_if(F.col("state").isNotNull() & F.col("fwd_ret").isNotNull()).alias("n"), F.max_by("state", "date").alias("last"))
    return feat.join(good.filter((F.col("n") >= least_usable) & F.col("last").isNotNull()), "ticker", "left_semi")


def own_verdicts(feat: DataFrame, cfg: Config, every: int = 63) -> DataFrame:
    """ticker, own_rows, own_gain, own_lo, own_hi, own_hit, own_hit_base, own_verdict of each ticker's own walk-forward.

    All over its dev period; tickers too short for one have no row.
    """
    rows = backtest.scored(feat, cfg, ["ticker"], every).filter("period = 'dev'")
    gain = F.col("ll_base") - F.col("ll_model")
    hit = lambda p: F.avg(((F.round(p, 9) > 0.5) == F.col("went_up")).cast("double"))
    sums = rows.groupBy("ticker").agg(F.count(F.lit(1)).alias("own_rows"), F.avg(gain).alias("own_gain"), hit("p_up_model").alias("own_hit"), hit("p_up_base").alias("own_hit_base"))
    bounds = resample.block_bootstrap_by(rows, gain, "date", cfg.horizon, "ticker").toDF("ticker", "own_lo", "own_hi")
    return sums.join(bounds, "ticker", "left").withColumn("own_verdict", verdict(F.col("own_lo"), F.col("own_hi")))


def card_models(feat: DataFrame, shown: DataFrame, cfg: Config) -> tuple[DataFrame, DataFrame]:
    """What the pool and its own model say of each shown ticker's last state, and the own model's states.

    The first has ticker, date, state, the factors, `pooled` and `own`; the second ticker and `own_states`.
    """
    latest = latest_rows(shown.select("ticker", "date", "state", *cfg.factors))
    pooled = model.predictions(model.fitted(feat, cfg), whole=True)
    numbers = [c for c in pooled.columns if c != "state"]
    pooled = pooled.select("state", F.struct(*numbers).alias("pooled"))
    own_states = hold(model.predictions(model.fitted(shown, cfg, ["ticker"]), ["ticker"], whole=True))
    own = own_states.select("ticker", "state", F.struct(*numbers).alias("own"))
    by_state = own_states.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("state", "n_rows", "p_up"))).alias("own_states"))
    return latest.join(F.broadcast(pooled), "state").join(own, ["ticker", "state"]), by_state  # pooled: one row per state


def cards(prices: DataFrame, feat: DataFrame, cfg: Config, least_usable: int = 300) -> DataFrame:
    """One row per ticker with enough usable rows and a state today.

    Price, changes, volatility, state, flags and history; `pooled` and `own` predictions of the
    state with their distributions by bucket and the baseline's; the own model's states and
    transitions; dollar moves of the buckets; the verdict of the ticker's own walk-forward, or
    `TOO_SHORT`.
    """
    shown = hold(with_usable(feat, least_usable))
    out, by_state = card_models(feat, shown, cfg)
    moves = model.transitions(shown, cfg, ["ticker"]).groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("from_state", "to_state", "n", "p"))).alias("transitions"))
    dollars = bucket_dollars(shown, cfg).groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("bucket", "label", "lo_dollars", "hi_dollars"))).alias("dollars"))
    for more in (recent(prices).drop("date"), by_state, moves, dollars):
        out = out.join(more, "ticker")
    out = out.join(own_verdicts(shown, cfg), "ticker", "left").withColumn("own_verdict", F.coalesce("own_verdict", F.lit(TOO_SHORT)))
    flags = F.create_map(*[x for f in cfg.factors for x in (F.lit(f), F.col(f))]).alias("flags")
    plain = [F.col(c) if t != "double" else clean(F.col(c)).alias(c) for c, t in out.dtypes if c not in cfg.factors]
    return out.select(*plain, flags)


def bucket_dollars(feat: DataFrame, cfg: Config) -> DataFrame:
    """ticker, bucket, label, lo_dollars, hi_dollars: the buckets' bounds as moves of the last price."""
    last = latest_rows(feat.select("ticker", "date", "close"))
    cells = last.join(F.broadcast(model.bucket_table(feat.sparkSession, cfg)))  # eight buckets
    move = lambda edge: F.round(F.col("close") * F.col(edge), 2)
    return cells.select("ticker", "bucket", "label", move("lo").alias("lo_dollars"), move("hi").alias("hi_dollars"))
