"""Market queries over the given tables. Numbers are rounded here, at the sink, and nowhere before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oddsmith.config import FACTORS, Config
from oddsmith.functions.columns import business_days_ahead, verdict
from oddsmith.functions.held import hold, release
from oddsmith.functions.shared import on_clear, shared_folder
from oddsmith.jobs.market_sql import SQL
from oddsmith.operators import backtest, model, resample, slices, sparse, universe
from oddsmith.operators import windows as w
from oddsmith.operators.factors import MEDIANS, features, joined, measured
from oddsmith.sources import adapters as a
from oddsmith.sources import payloads, readers, store

CFG = Config()
LEAST_USABLE = 100  # of a card's ticker: the given prices have about 500 rows a ticker
FOLDER = 500  # tickers of a payload folder, some ten MB
OUTSIDER = "S00003"  # a ticker that is kept out of the pool


def rounded(df: DataFrame, digits: int = 6, but: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in but else F.col(c) for c, t in df.dtypes])


def owned(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query as one job: what the job before has held is given up when it begins."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        release(spark)
        return query(spark, d)

    return run


def feat(spark: SparkSession, d: str, cfg: Config = CFG, reused: bool = False) -> DataFrame:
    """`reused`: the job reads them more than once, so they are held."""
    out = features(a.prices(spark, d), a.market(spark, d), cfg)
    return hold(out) if reused else out


def scored(spark: SparkSession, d: str) -> DataFrame:
    return backtest.scored(feat(spark, d), CFG)


def dev(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).filter("period = 'dev'")


def gain_interval(spark: SparkSession, d: str) -> DataFrame:
    return resample.block_bootstrap(dev(spark, d), F.col("ll_base") - F.col("ll_model"), "date", CFG.horizon)


def fitted(spark: SparkSession, d: str) -> DataFrame:
    return model.fitted(feat(spark, d, reused=True), CFG)


def meta(spark: SparkSession, d: str) -> DataFrame:
    return a.meta(a.prices(spark, d))


def vendor_ingest(spark: SparkSession, d: str) -> DataFrame:
    rows = a.prices(spark, d)
    lines = rows.select("ticker", F.concat_ws(",", F.date_format("date", "yyyy-MM-dd"), *[F.col("close").cast("string")] * 4, F.col("volume").cast("string"), F.lit("0")).alias("value"))
    allowed = rows.select("ticker").distinct().filter("ticker <> 'S00003'")
    return readers.vendor_rows(lines, allowed).groupBy("ticker").agg(F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first"), F.max("date").alias("last"), F.sum("volume").alias("volume"))


def adj_close_prefer(spark: SparkSession, d: str) -> DataFrame:
    adjusted = F.when(F.dayofmonth("date") % 2 == 0, F.col("close") / 2)
    fields = F.struct(F.date_format("date", "yyyy-MM-dd").alias("date"), "close", "volume", adjusted.alias("adjClose"))
    lines = a.prices(spark, d).select("ticker", F.to_json(fields).alias("value"))
    return readers.eod_rows(lines).select("ticker", "date", "close")  # short decimals need no rounding


def delisted_select(spark: SparkSession, d: str) -> DataFrame:
    gone = meta(spark, d).filter("fate = 'delisted' and last >= date '1999-01-01'")
    return gone.orderBy(F.desc("last"), "ticker").limit(10).select("ticker", "last")


def ticker_list_parse(spark: SparkSession, d: str) -> DataFrame:
    symbol = F.concat(F.lit(" c"), F.col("c_custkey").cast("string"))
    line = F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("# "), F.col("c_name"))).when(F.col("c_custkey") % 3 == 0, F.concat(symbol, F.lit(" "))).otherwise(F.concat(symbol, F.lit(", "), F.col("c_name")))
    return readers.ticker_list(a.table(spark, d, "customer").select(line.alias("value")))


def prices_unpivot(spark: SparkSession, d: str) -> DataFrame:
    wide = a.market(spark, d)
    return readers.long_prices(wide, ["sector_close", "vix", "tnx"], 400)


def market_pivot(spark: SparkSession, d: str) -> DataFrame:
    return readers.wide_market(readers.long_prices(a.market(spark, d), ["sector_close", "vix", "tnx"], 0), ["sector_close", "vix", "tnx"])


def union_sources(spark: SparkSession, d: str) -> DataFrame:
    m = meta(spark, d)
    gone = m.filter("fate = 'delisted'").select("ticker", F.col("last").alias("delisted_date"))
    return gone.unionByName(m.filter("fate = 'active'").select("ticker"), allowMissingColumns=True).distinct()


def incremental_anti(spark: SparkSession, d: str) -> DataFrame:
    rows = a.prices(spark, d)
    return rows.select("ticker").distinct().join(a.meta(rows).filter("fate = 'delisted'"), "ticker", "left_anti")


def rolling_median(spark: SparkSession, d: str) -> DataFrame:
    rows = measured(joined(a.prices(spark, d), a.market(spark, d)), CFG, MEDIANS)
    return rounded(rows.select("ticker", "date", "vix_median", "rv_median", "volume_median"))


def history_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = universe.with_history(joined(a.prices(spark, d), a.market(spark, d)), CFG.regime_window + CFG.horizon + 50)
    return rows.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_rows"))


def predict_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = feat(spark, d, reused=True)
    pooled = model.moments(model.fitted(rows, CFG)).select("state", "n_rows", "p_up", "p_up_base", "ev")
    last = universe.latest_rows(rows.select("ticker", "date", "state"))
    return rounded(last.join(F.broadcast(pooled), "state").select("ticker", "date", "state", "n_rows", "p_up", "p_up_base", "ev"))


def score_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = hold(feat(spark, d).select(*backtest.SCORED_FROM))
    return rounded(backtest.summary(backtest.scored(rows, CFG), CFG, model.cluster_factor(rows, CFG)))


def calibration(spark: SparkSession, d: str) -> DataFrame:
    rows = dev(spark, d).withColumn("p_up_model", F.round("p_up_model", 9))
    return rounded(resample.calibration(rows, "p_up_model", F.col("went_up")))


def recent_history(spark: SparkSession, d: str) -> DataFrame:
    out = universe.recent_history(a.prices(spark, d))
    ends = (F.element_at("history", 1)["date"].alias("first"), F.element_at("history", -1)["date"].alias("last"))
    return out.select("ticker", "n_days", "low", "high", *ends)


def last_dev_months(spark: SparkSession, d: str) -> DataFrame:
    track = backtest.track_record(scored(spark, d), CFG).filter("period = 'dev'")
    k = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))
    return rounded(track.withColumn("k", k).filter("k <= 24").select("ticker", "date", "ev_model", "realized"))


def focal_prediction(spark: SparkSession, d: str) -> DataFrame:
    """The last state of the focal ticker, here the first active one because the wanted one is unknown."""
    rows = feat(spark, d, reused=True)
    one = universe.focal_ticker(meta(spark, d), "NONE")  # one row
    return rounded(universe.predicted(rows.join(F.broadcast(one), "ticker"), model.fitted(rows, CFG)))


def outside_prediction(spark: SparkSession, d: str) -> DataFrame:
    """A ticker outside the pool: features of its own, scored with the pooled model."""
    own = F.col("ticker") == OUTSIDER
    prices, market = a.prices(spark, d), a.market(spark, d)
    pool = hold(features(prices.filter(~own), market, CFG))
    return rounded(universe.predicted(features(prices.filter(own), market, CFG), model.fitted(pool, CFG)))


def terminal_tickers(spark: SparkSession, d: str) -> DataFrame:
    return universe.with_usable(feat(spark, d), LEAST_USABLE).groupBy("ticker").agg(F.count(F.lit(1)).alias("n_rows"))


def ticker_cards(spark: SparkSession, d: str) -> DataFrame:
    """The cards' numbers; nested parts (history, transitions, states, dollars) by their sums and sizes."""
    cards = universe.cards(a.prices(spark, d), feat(spark, d, reused=True), CFG, LEAST_USABLE)
    numbers = ("n_rows", "independent_obs", "weight_on_state", "p_up", "p_up_base", "ev", "std")
    flat = [F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("pooled", "own") for c in numbers]
    added = lambda column, part: F.aggregate(column, F.lit(0.0), lambda s, x: s + F.coalesce(x[part].cast("double"), F.lit(0.0)))
    return rounded(
        cards.select(
            "ticker", "date", "close", "state", *[F.col("flags")[f].alias(f) for f in CFG.factors], "change_1", "change_21", "change_252", "vol", "n_days", "low", "high", *flat,
            "own_rows", "own_gain", "own_lo", "own_hi", "own_hit", "own_hit_base", "own_verdict",
            F.element_at("history", 1)["date"].alias("history_first"), added("own_states", "p_up").alias("own_p_up_sum"), added("transitions", "n").alias("transitions_n"),
            added(F.filter("transitions", lambda x: x["from_state"] == x["to_state"]), "p").alias("p_stay_sum"), F.round(added(F.filter("dollars", lambda x: x["bucket"] > 3), "hi_dollars"), 2).alias("dollars_up_sum"),
        ),
        but=("close", "low", "high"),  # short decimals
    )


def ticker_transitions(spark: SparkSession, d: str) -> DataFrame:
    rows = universe.with_usable(feat(spark, d, reused=True), LEAST_USABLE)
    return rounded(model.transitions(rows, CFG, ["ticker"]))


def ticker_models(spark: SparkSession, d: str) -> DataFrame:
    rows = universe.with_usable(feat(spark, d, reused=True), LEAST_USABLE)
    return rounded(model.predictions(model.fitted(rows, CFG, ["ticker"]), ["ticker"]).drop("kelly_full", "kelly_half"))


def walk_forward_by_ticker(spark: SparkSession, d: str) -> DataFrame:
    cfg = Config(min_train_years=1)
    return rounded(backtest.scored(feat(spark, d, cfg), cfg, ["ticker"], every=63))


def sparse_fit_cells(spark: SparkSession, d: str) -> DataFrame:
    """The change points of all tickers' own fits, over all buckets."""
    cfg = Config(min_train_years=1)
    rows = hold(backtest.attached(feat(spark, d, cfg, reused=True), cfg, ["ticker"], 63))
    found = sparse.change_points(rows, cfg, ["ticker"])
    added = lambda part: sum([F.col(f"{part}{k}") for k in range(1, len(cfg.edges) + 1)], F.col(f"{part}0"))
    return rounded(found.select("ticker", "fit_id", "state", added("n").alias("n"), added("r").alias("sum_r")))


def new_store(spark: SparkSession, d: str) -> store.PriceStore:
    """A store of its own for one job, filled twice: the tickers that ended first, then a feed of all, whose stored tickers are skipped."""
    path = shared_folder(spark, "prices")
    out = store.PriceStore(spark, "prices_" + path[-32:], path, buckets=8)
    on_clear(spark, out.drop)
    rows = a.prices(spark, d)
    out.ingest(rows.join(meta(spark, d).filter("fate = 'delisted'"), "ticker", "left_semi"))
    return out


def price_store(spark: SparkSession, d: str) -> DataFrame:
    """What the store holds after a second ingest whose closes differ by 1,000: old tickers keep their own."""
    kept = new_store(spark, d)
    kept.ingest(a.prices(spark, d).withColumn("close", F.col("close") + 1000))
    kept.compact()
    return rounded(kept.tickers().join(kept.prices().groupBy("ticker").agg(F.sum(F.floor(F.col("close") * 1000)).alias("total")), "ticker"))


def store_features(spark: SparkSession, d: str) -> DataFrame:
    """Features of a store's prices: no exchange by ticker."""
    kept = new_store(spark, d)
    kept.ingest(a.prices(spark, d))
    return rounded(features(kept.prices(), a.market(spark, d), CFG).select("ticker", "date", "state", "fwd_ret"))


def features_in_slices(spark: SparkSession, d: str) -> DataFrame:
    rows = slices.features(a.prices(spark, d), a.market(spark, d), CFG, size=300, days=200)
    return rounded(rows.select("ticker", "date", "state", "fwd_ret"))


def stored_history(spark: SparkSession, d: str) -> DataFrame:
    """Histories of a payload that was written twice: first without a third of the tickers' closes, which the second writing replaces."""
    path = shared_folder(spark, "payloads")
    rows = hold(universe.recent(a.prices(spark, d)))
    groups = max(1, -(-rows.count() // FOLDER))
    third = F.crc32(F.col("ticker").cast("binary")) % 3 == 0
    payloads.replace(rows.withColumn("history", F.when(~third, F.col("history"))), path, groups=groups)
    payloads.replace(rows, path, groups=groups)
    return payloads.stored(spark, path, rows.schema).select("ticker", F.inline("history"))


def card_buckets(spark: SparkSession, d: str) -> DataFrame:
    """The distributions of the cards, pooled and own, a row a bucket."""
    rows = feat(spark, d, reused=True)
    cards = universe.card_models(rows, universe.with_usable(rows, LEAST_USABLE), CFG)[0]
    each = lambda side: F.transform(F.arrays_zip(f"{side}.probs", f"{side}.baseline", f"{side}.bucket_mean"), lambda x, k: F.struct(F.lit(side).alias("side"), k.alias("bucket"), x["probs"].alias("p"), x["baseline"].alias("q"), x["bucket_mean"].alias("mean")))
    return rounded(cards.select("ticker", F.inline(F.concat(each("pooled"), each("own")))))


def baseline_moments(spark: SparkSession, d: str) -> DataFrame:
    rows = universe.with_usable(feat(spark, d, reused=True), LEAST_USABLE)
    found = model.predictions(model.fitted(rows, CFG, ["ticker"]), ["ticker"], whole=True).filter("state = 'Up/Up/HighVIX'")
    return rounded(found.select("ticker", "ev_base", "std_base", "ev_over_std_base"))


def _factor(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: features(a.prices(spark, d), a.market(spark, d), CFG, flags_of=(name,)).select("ticker", "date", name)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    prices, market = a.prices, a.market
    dates = lambda s, d: backtest.dated_fits(feat(s, d), CFG)
    fits = lambda s, d: backtest.expanding_fits(backtest.attached(feat(s, d, reused=True), CFG), CFG)
    numbers = lambda s, d: model.moments(fitted(s, d))
    logged = lambda s, d: joined(prices(s, d), market(s, d)).withColumn("log_return", w.log_return())
    found = {
        "prices_min_history": lambda s, d: universe.with_history(prices(s, d), 300),
        "vendor_ingest": vendor_ingest,
        "adj_close_prefer": adj_close_prefer,
        "delisted_select": delisted_select,
        "ticker_list_parse": ticker_list_parse,
        "prices_unpivot": prices_unpivot,
        "market_pivot": market_pivot,
        "union_sources": union_sources,
        "incremental_anti": incremental_anti,
        "fate_from_gap": meta,
        "fate_counts": lambda s, d: meta(s, d).groupBy("fate").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first"), F.max("last").alias("last")),
        "alive_by_year": lambda s, d: universe.alive_by_year(meta(s, d)),
        "equal_weight_index": lambda s, d: rounded(universe.equal_weight_index(prices(s, d))),
        "market_join_ffill": lambda s, d: joined(prices(s, d), market(s, d)).select("ticker", "date", "close", "sector_close", "vix", "tnx"),
        "ffill": lambda s, d: prices(s, d).join(F.broadcast(market(s, d)), "date", "left").select("ticker", "date", w.filled("tnx").alias("tnx")),
        "realized_vol": lambda s, d: rounded(logged(s, d).select("ticker", "date", w.rolling_std("log_return", CFG.vol_window).alias("rv"))),
        "rolling_mean_volume": lambda s, d: rounded(logged(s, d).select("ticker", "date", w.rolling_mean("volume", CFG.vol_window).alias("mean_volume"))),
        "rolling_median": rolling_median,
        "history_filter": history_filter,
        **{f"factor_{f}": _factor(f) for f in FACTORS},
        "state_assign": lambda s, d: feat(s, d).select("ticker", "date", "state"),
        "fwd_return": lambda s, d: rounded(feat(s, d).select("ticker", "date", "fwd_ret")),
        "fwd_return_relative": lambda s, d: rounded(feat(s, d, Config(relative=True)).select("ticker", "date", "fwd_ret")),
        "bucket_assign": lambda s, d: model.with_bucket(feat(s, d), CFG).select("ticker", "date", "bucket"),
        "bucket_dollars": lambda s, d: universe.bucket_dollars(feat(s, d), CFG),
        "business_day_add": lambda s, d: feat(s, d).select("date").distinct().select("date", business_days_ahead(F.col("date"), CFG.horizon).alias("known_at")),
        "cluster_factor": lambda s, d: rounded(model.cluster_factor(feat(s, d), CFG)),
        "state_bucket_counts": lambda s, d: rounded(model.counted(model.usable_rows(feat(s, d)), CFG).select("state", "bucket", "n", "sum_r", "sum_r2")),
        "unconditional": lambda s, d: rounded(fitted(s, d).groupBy("bucket").agg(*[F.max(c).alias(c) for c in ("q", "m_bucket", "m2_bucket")])),
        "shrunk_probs": lambda s, d: rounded(fitted(s, d).select("state", "bucket", "n", "w", "q", "p")),
        "state_moments": lambda s, d: rounded(numbers(s, d).select("state", "ev", "std", "ev_over_std", F.round("kelly_full", 4).alias("kelly_full"), F.round("kelly_half", 4).alias("kelly_half"))),
        "state_table": lambda s, d: rounded(numbers(s, d).select("state", "n_rows", "n_eff", "p_up", "ev", "std")),
        "predict_state": lambda s, d: rounded(fitted(s, d).filter("state = 'Up/Up/LowVIX'").select("bucket", "p", "q", (F.col("p") * F.col("m")).alias("contribution"))),
        "predict_record": lambda s, d: rounded(model.predictions(fitted(s, d)).drop("kelly_full", "kelly_half")),
        "predict_latest": predict_latest,
        "focal_prediction": focal_prediction,
        "outside_prediction": outside_prediction,
        "transition_matrix": lambda s, d: rounded(model.transitions(feat(s, d, reused=True), CFG)),
        "survivorship_gap": lambda s, d: rounded(universe.survivorship_gap(feat(s, d, reused=True), meta(s, d), CFG)),
        "latest_state": lambda s, d: universe.latest_rows(feat(s, d)).select("ticker", "date", "state", *CFG.factors),
        "lookback_changes": lambda s, d: rounded(universe.lookbacks(prices(s, d)), but=("close",)),
        "annualised_vol": lambda s, d: rounded(universe.annualised_vol(prices(s, d))),
        "recent_history": recent_history,
        "ticker_search": lambda s, d: readers.search(a.table(s, d, "supplier").select("s_suppkey", "s_name"), "R#00000000", ["s_name"]),
        "refit_calendar": lambda s, d: backtest.refit_calendar(feat(s, d), CFG),
        "asof_fit": lambda s, d: dates(s, d).select("date", "test_fit"),
        "purge_fit": lambda s, d: dates(s, d).select("date", "train_fit"),
        "expanding_fit": lambda s, d: rounded(fits(s, d).select("fit_id", "state", "bucket", "n", "sum_r")),
        "fit_guard": lambda s, d: fits(s, d).select("fit_id", "n_seen").distinct(),
        "predict_rows": lambda s, d: rounded(scored(s, d).select("date", "ticker", "state", "p_up_model", "p_up_base")),
        "log_loss": lambda s, d: rounded(scored(s, d).select("date", "ticker", "ll_model", "ll_base")),
        "brier": lambda s, d: rounded(scored(s, d).select("date", "ticker", "brier_model", "brier_base")),
        "walk_forward": lambda s, d: rounded(scored(s, d)),
        "holdout_split": lambda s, d: scored(s, d).groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last")),
        "score_summary": score_summary,
        "calibration": calibration,
        "block_bootstrap": lambda s, d: rounded(gain_interval(s, d)),
        "verdict": lambda s, d: gain_interval(s, d).select(verdict(F.col("lo"), F.col("hi")).alias("verdict")),
        "track_record": lambda s, d: rounded(backtest.track_record(scored(s, d), CFG)),
        "track_record_summary": lambda s, d: rounded(backtest.track_record_summary(backtest.track_record(scored(s, d), CFG))),
        "last_dev_months": last_dev_months,
        "price_store": price_store,
        "store_features": store_features,
        "features_in_slices": features_in_slices,
        "sparse_fit_cells": sparse_fit_cells,
        "stored_history": stored_history,
        "card_buckets": card_buckets,
        "baseline_moments": baseline_moments,
        "ticker_cards": ticker_cards,
        "ticker_models": ticker_models,
        "ticker_transitions": ticker_transitions,
        "terminal_tickers": terminal_tickers,
        "walk_forward_by_ticker": walk_forward_by_ticker,
    }
    return {name: owned(query) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
