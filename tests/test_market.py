"""Market jobs: mini tables, the leak test, the slow loop, and planted effects."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from oddsmith.config import Config
from oddsmith.functions.columns import bucket, business_days_ahead, verdict
from oddsmith.operators import backtest, factors, model, resample, universe
from oddsmith.operators import windows as w
from oddsmith.sources import adapters

CFG = Config(factors=("vix_regime",), min_train_years=1)


def test_config_rejects_unknown_factors():
    with pytest.raises(ValueError):
        Config(factors=("luck",))
    with pytest.raises(ValueError):
        Config(edges=(0.1, 0.0))


def test_buckets_are_closed_on_the_left(spark):
    values = [-0.2, -0.10, -0.05, -0.02, 0.0, 0.0199, 0.02, 0.05, 0.10, math.inf, math.nan, None]
    rows = spark.createDataFrame([(v,) for v in values], "r double").select(bucket(F.col("r"), Config().edges).alias("b")).collect()
    assert [r["b"] for r in rows] == [0, 1, 2, 3, 4, 4, 5, 6, 7, 7, None, None]


@pytest.mark.parametrize("n", [1, 5, 21, 63])
def test_business_days_equal_pandas(spark, n):
    days = pd.date_range("2020-01-01", periods=40)
    rows = spark.createDataFrame([(d.date(),) for d in days], "d date").select("d", business_days_ahead(F.col("d"), n).alias("e")).collect()
    assert all(pd.Timestamp(r["e"]) == pd.Timestamp(r["d"]) + pd.tseries.offsets.BDay(n) for r in rows)


def test_bucket_labels_and_dollar_moves(spark):
    rows = model.bucket_table(spark, Config()).orderBy("bucket").collect()
    assert [r["label"] for r in rows] == ["below -10%", "-10% to -5%", "-5% to -2%", "-2% to +0%", "+0% to +2%", "+2% to +5%", "+5% to +10%", "above +10%"]
    feat = spark.createDataFrame([("A", dt.date(2020, 1, 1), 50.0), ("A", dt.date(2020, 1, 2), 200.0)], "ticker string, date date, close double")
    moves = {r["bucket"]: (r["lo_dollars"], r["hi_dollars"]) for r in universe.bucket_dollars(feat, Config()).collect()}
    assert moves[0] == (None, -20.0) and moves[1] == (-20.0, -10.0) and moves[4] == (0.0, 4.0) and moves[7] == (20.0, None)


def test_focal_ticker_and_terminal_rule(spark):
    meta = spark.createDataFrame([("B", "active"), ("A", "delisted"), ("C", "active")], "ticker string, fate string")
    assert [universe.focal_ticker(meta, t).first()[0] for t in ("A", "C", "Z")] == ["A", "C", "B"]
    days = [dt.date(2020, 1, d) for d in range(1, 6)]
    feat = [("A", d, "s", 0.1) for d in days] + [("B", d, "s" if d != days[-1] else None, 0.1) for d in days] + [("C", d, "s", 0.1 if d < days[2] else None) for d in days]
    rows = universe.with_usable(spark.createDataFrame(feat, "ticker string, date date, state string, fwd_ret double"), 4)
    assert {r["ticker"] for r in rows.select("ticker").collect()} == {"A"}


def test_bootstrap_by_key_equals_that_of_each_key(spark):
    rng = np.random.default_rng(5)
    rows = [(k, i // 2, float(rng.normal(0.1))) for k, n in (("a", 120), ("b", 90), ("c", 10)) for i in range(n)]
    frame = spark.createDataFrame(rows, "k string, unit int, v double")
    found = {r["k"]: (r["lo"], r["hi"]) for r in resample.block_bootstrap_by(frame, F.col("v"), "unit", 7, "k", draws=200).collect()}
    assert set(found) == {"a", "b"}
    for k, bounds in found.items():
        assert bounds == pytest.approx(tuple(resample.block_bootstrap(frame.filter(F.col("k") == k), F.col("v"), "unit", 7, draws=200).first()))


def test_a_day_with_several_market_rows_counts_once(spark, tables):
    prices, market = tables
    assert factors.joined(prices, market.unionByName(market)).count() == factors.joined(prices, market).count()


def test_held_frames_are_given_up(spark):
    from oddsmith.functions import held

    frame = held.hold(spark.range(5))
    assert frame.is_cached
    held.release(spark)
    assert not frame.storageLevel.useMemory and frame.count() == 5


def test_verdicts(spark):
    rows = spark.createDataFrame([(0.1, 0.2), (-0.2, -0.1), (-0.1, 0.1), (None, 0.1), (math.nan, 1.0)], "lo double, hi double")
    words = [r[0].split()[0] for r in rows.select(verdict(F.col("lo"), F.col("hi"))).collect()]
    assert words == ["better", "worse", "indistinguishable", "too", "too"]


def bars(tickers=3, n=420, seed=0):
    rng = np.random.default_rng(seed)
    days = pd.bdate_range("2015-01-01", periods=n)
    rows = []
    for t in range(tickers):
        close = 100 * np.exp(np.cumsum(0.01 * rng.normal(size=n)))
        rows += [(f"T{t}", d.date(), float(c), float(v)) for d, c, v in zip(days, close, rng.integers(1, 100, n), strict=True)]
    market = [(d.date(), 100 + float(x), 15 + float(y), None if i < 5 else float(z)) for i, (d, x, y, z) in enumerate(zip(days, np.cumsum(rng.normal(size=n)), rng.normal(size=n), rng.normal(size=n), strict=True))]
    return rows, market


@pytest.fixture(scope="module")
def tables(spark):
    rows, market = bars()
    return spark.createDataFrame(rows, "ticker string, date date, close double, volume double"), spark.createDataFrame(market, "date date, sector_close double, vix double, tnx double")


def test_features_equal_pandas(spark, tables):
    cfg = Config()
    got = factors.features(*tables, cfg, flags_of=tuple(factors.REGISTRY)).toPandas().sort_values(["ticker", "date"]).reset_index(drop=True)
    prices, market = (t.toPandas() for t in tables)
    for ticker, own in prices.groupby("ticker"):
        g = own.sort_values("date").merge(market, on="date", how="left").set_index("date")
        rv = np.log(g["close"]).diff().rolling(21).std()
        up, sector, vix = g["close"].pct_change(63) > 0, g["sector_close"].pct_change(63) > 0, g["vix"] > g["vix"].rolling(252).median()
        warm = g["close"].pct_change(63).notna() & rv.rolling(252).median().notna()
        state = np.where(up, "Up/", "Down/") + np.where(sector, "Up/", "Down/") + np.where(vix, "HighVIX", "LowVIX")
        mine = got[got["ticker"] == ticker].set_index("date")
        assert [s if ok else None for s, ok in zip(state, warm, strict=True)] == mine["state"].tolist()
        assert warm.to_numpy().argmax() == 272
        assert np.allclose(mine["fwd_ret"], g["close"].shift(-21) / g["close"] - 1, equal_nan=True)
        assert (mine["vol_regime"].to_numpy() == (rv > rv.rolling(252).median()).to_numpy()).all()
        assert (mine["rate_trend"].to_numpy() == (g["tnx"].diff(63) > 0).to_numpy()).all()


def test_both_rolling_medians_agree(spark, tables):
    rows = tables[0].withColumn("plain", w.rolling_median("close", 30))
    out = w.with_medians(rows, {"quick": "close"}, 30).toPandas()
    assert np.allclose(out["plain"], out["quick"], equal_nan=True) and out["quick"].isna().sum() == 29 * 3


def test_fill_follows_the_tickers_own_dates(spark):
    day = lambda n: dt.date(2020, 1, n)
    prices = spark.createDataFrame([("A", day(1), 1.0, 1.0), ("A", day(2), 1.0, 1.0), ("A", day(5), 1.0, 1.0)], "ticker string, date date, close double, volume double")
    market = spark.createDataFrame([(day(2), 10.0, 20.0, None), (day(3), 11.0, 21.0, 3.0)], "date date, sector_close double, vix double, tnx double")
    rows = factors.joined(prices, market).orderBy("date").collect()
    assert [(r["date"], r["sector_close"], r["tnx"]) for r in rows] == [(day(2), 10.0, None), (day(5), 10.0, None)]


def planted(n=1500, signal=True, seed=3):
    rng = np.random.default_rng(seed)
    days = pd.bdate_range("2005-01-01", periods=n)
    high = np.repeat(rng.random(n // 20 + 1) < 0.5, 20)[:n]
    ret = np.where(high, -0.06, 0.04) + 0.05 * rng.normal(size=n) if signal else 0.08 * rng.normal(size=n)
    ret[-21:] = np.nan
    return [("X", d.date(), 1.0, "HighVIX" if h else "LowVIX", None if np.isnan(r) else float(r)) for d, h, r in zip(days, high, ret, strict=True)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "ticker string, date date, close double, state string, fwd_ret double")


def loop(rows, cfg):
    """The walk-forward as a plain loop over refits: date -> (p of the realised bucket, q of it)."""
    f = pd.DataFrame(rows, columns=["ticker", "date", "close", "state", "r"])
    f["date"] = pd.to_datetime(f["date"])
    cluster = max(1.0, f.groupby("date").size().mean())
    known = f[f["state"].notna() & f["r"].notna()].copy()
    known["k"] = np.searchsorted(cfg.edges, known["r"], side="right")
    known["at"] = known["date"] + pd.tseries.offsets.BDay(cfg.horizon)
    days = np.sort(f["date"].unique())
    fits = [d for d in days[:: cfg.refit_every] if d >= days[0] + pd.Timedelta(days=int(cfg.min_train_years * 365))]
    out = {}
    for i, t in enumerate(fits):
        train = known[known["at"] <= t]
        if train["state"].nunique() < 2:
            continue
        test = known[(known["date"] >= t) & ((known["date"] < fits[i + 1]) if i + 1 < len(fits) else True)]
        q = np.bincount(train["k"], minlength=8) / len(train)
        for row in test.itertuples():
            own = train[train["state"] == row.state]
            weight = len(own) / (cfg.horizon * cluster)
            weight = weight / (weight + cfg.prior_strength)
            p = weight * np.bincount(own["k"], minlength=8) / max(len(own), 1) + (1 - weight) * q
            out[row.ticker, row.date.date()] = (-np.log(max(p[row.k], 1e-12)), -np.log(max(q[row.k], 1e-12)))
    return out


def test_one_pass_equals_the_loop(spark):
    rows = planted(700)
    rows += [("Y", d, c, None if i % 9 == 0 else ("LowVIX" if s == "HighVIX" else s), r) for i, (_, d, c, s, r) in enumerate(planted(600, seed=9))]
    expected = loop(rows, CFG)
    got = {(r["ticker"], r["date"]): (r["ll_model"], r["ll_base"]) for r in backtest.scored(frame(spark, rows), CFG).collect()}
    assert got.keys() == expected.keys() and len(got) > 300
    assert all(np.allclose(got[k], expected[k]) for k in got)


def test_the_future_does_not_move_the_past(spark):
    rows = planted(600)
    cut = rows[450][1]
    changed = [(t, d, c, s, None if r is None else (r if d < cut - dt.timedelta(days=40) else -r)) for t, d, c, s, r in rows]
    a, b = ({r["date"]: (r["p_up_model"], r["ev_model"]) for r in backtest.scored(frame(spark, x), CFG).collect()} for x in (rows, changed))
    before = [d for d in a if d < cut - dt.timedelta(days=40)]
    assert len(before) > 50 and all(a[d] == pytest.approx(b[d]) for d in before)


def test_planted_signal_is_found_and_noise_is_not(spark):
    for signal in (True, False):
        feat = frame(spark, planted(3000, signal))
        dev = backtest.scored(feat, Config(factors=("vix_regime",))).filter("period = 'dev'").persist()
        gain = dev.agg(F.avg(F.col("ll_base") - F.col("ll_model")), F.avg(((F.col("p_up_model") > 0.5) == F.col("went_up")).cast("double"))).first()
        lo, hi = resample.block_bootstrap(dev, F.col("ll_base") - F.col("ll_model"), "date", 21).first()
        if signal:
            assert gain[0] > 0.05 and gain[1] > 0.7 and lo > 0
        else:
            assert lo <= 0 <= hi or abs(gain[0]) < 0.01


def test_bootstrap_needs_two_blocks(spark):
    rows = spark.createDataFrame([(dt.date(2020, 1, i + 1), 1.0) for i in range(9)], "date date, x double")
    assert tuple(resample.block_bootstrap(rows, F.col("x"), "date", 5).first()) == (None, None)
    assert tuple(resample.block_bootstrap(rows, F.col("x"), "date", 3).first()) == (1.0, 1.0)


def test_holdout_starts_at_a_whole_date(spark):
    rows = [(dt.date(2020, 1, d), i) for d in range(1, 6) for i in range(4)]
    cut = backtest.holdout_cut(spark.createDataFrame(rows, "date date, i int"), 0.3).first()[0]
    assert cut == dt.date(2020, 1, 4)  # position 14 of 20


def test_locked_holdout_shows_no_scores(spark):
    feat = frame(spark, planted(700))
    rows = {r["period"]: r for r in backtest.summary(backtest.scored(feat, CFG), CFG, model.cluster_factor(feat, CFG)).collect()}
    assert rows["holdout"]["logloss_gain"] is None and rows["holdout"]["rows"] > 0 and rows["dev"]["logloss_gain"] is not None


def test_auc_gives_ties_their_middle_rank(spark):
    rows = spark.createDataFrame([(1, 0.5, 1), (1, 0.5, 0), (1, 0.9, 1), (1, 0.1, 0), (2, 0.3, 1)], "g int, s double, y int")
    found = {r["g"]: r["auc"] for r in resample.auc(rows, "s", "y", ["g"]).collect()}
    assert found == {1: 0.875, 2: None}


def test_transitions_stay_within_a_ticker(spark):
    rows = [(t, dt.date(2020, 1, 1) + dt.timedelta(days=i), 1.0, "HighVIX" if (i + k) % 2 else "LowVIX", 0.01) for k, t in enumerate("AB") for i in range(30)]
    cells = {(r["from_state"], r["to_state"]): r for r in model.transitions(frame(spark, rows), CFG).collect()}
    assert sum(c["n"] for c in cells.values()) == 2 * (30 - 21)
    assert cells["HighVIX", "LowVIX"]["n"] + cells["LowVIX", "HighVIX"]["n"] == 18
    for a in ("HighVIX", "LowVIX"):
        assert sum(cells[a, b]["p"] for b in ("HighVIX", "LowVIX")) == pytest.approx(1)


def test_empty_state_takes_the_baseline(spark):
    rows = [("A", dt.date(2020, 1, 1) + dt.timedelta(days=i), 1.0, "HighVIX", 0.01 * (i % 5 - 2)) for i in range(40)]
    cells = model.fitted(frame(spark, rows), CFG).filter("state = 'LowVIX'").collect()
    assert len(cells) == 8 and all(c["p"] == c["q"] and c["w"] == 0 for c in cells)


def test_index_counts_the_living_or_all(spark):
    day = lambda n: dt.date(2020, 1, n)
    rows = [("A", day(1), 100.0), ("A", day(2), 110.0), ("A", day(3), 110.0), ("B", day(1), 100.0), ("B", day(2), 90.0)]
    prices = spark.createDataFrame(rows, "ticker string, date date, close double")
    alive = [round(r["ret"], 6) for r in universe.equal_weight_index(prices.replace(110.0, 121.0)).orderBy("date").collect()]
    assert alive == [round((0.21 - 0.1) / 2, 6), 0.0]
    assert universe.equal_weight_index(prices, pad_dead=True).count() == 2


def test_fits_along_keys_are_those_of_the_calendar(spark):
    """Odd dates, weekends, repeated days and keys of different lengths; no join is needed."""
    rng = np.random.default_rng(5)
    rows = [(f"T{t}", (dt.date(2015, 1, 1) + dt.timedelta(days=int(x))), "s", 0.01) for t, n in enumerate((5, 300, 900)) for x in np.sort(rng.integers(0, 1500, n))]
    feat = spark.createDataFrame(rows, "ticker string, date date, state string, fwd_ret double")
    cfg = Config(min_train_years=1)
    out = backtest.attached(feat, cfg, ["ticker"], 63)
    joined = feat.join(backtest.dated_fits(feat, cfg, ["ticker"], 63), ["ticker", "date"])
    columns = ["ticker", "date", "test_fit", "train_fit"]
    assert out.select(columns).exceptAll(joined.select(columns)).count() == joined.select(columns).exceptAll(out.select(columns)).count() == 0
    assert out.filter("test_fit > 0 and train_fit is not null").count() > 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_models_per_key_are_worked_out_once_a_state_and_fit(spark):
    feat = spark.range(4000).selectExpr("concat('T', id % 2) ticker", "date_add(date '2015-01-01', cast(id div 2 as int)) date", "concat('s', hash(id) % 2) state", "sin(id) / 10 fwd_ret")
    out = backtest.scored(feat, Config(min_train_years=1), ["ticker"], 63)
    assert out.count() > 2000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "test#" not in plan  # the tested rows are no part of the looked-up line


def test_draws_of_keys_equal_the_draws_of_each_alone(spark):
    rows = spark.range(300).selectExpr("if(id < 100, 'a', if(id < 290, 'b', 'c')) k", "date_add(date '2020-01-01', cast(id as int)) date", "cos(id) v")
    found = {r["k"]: (r["lo"], r["hi"]) for r in resample.block_bootstrap_by(rows, F.col("v"), "date", 7, "k", draws=200).collect()}
    assert set(found) == {"a", "b"}
    for k in "ab":
        assert found[k] == pytest.approx(tuple(resample.block_bootstrap(rows.filter(F.col("k") == k), F.col("v"), "date", 7, draws=200).first()), abs=1e-12)
    plan = resample.block_bootstrap_by(rows, F.col("v"), "date", 7, "k", draws=200)._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan  # no row a draw


def test_lines_are_dealt_by_ticker_once(spark, tmp_path):
    lines = "id % 3 l_suppkey, cast(date_add(date '1995-01-01', cast(id div 6 as int)) as timestamp) l_shipdate, 0.05 l_discount, 0.02 l_tax, 100.25 + id l_extendedprice, 1.0 l_quantity"
    spark.sql(f"SELECT {lines} FROM range(600)").write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = adapters.prices(spark, str(tmp_path)).withColumn("r", w.log_return())
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert rows.count() == 300


def test_hundredths_are_those_of_the_decimal(spark):
    odd = [0.01, 1.005, 2.675, -1.005, 1e9 + 0.01, 123456789012.34, None, 0.1 + 0.2, 99999.995, -0.01]
    rows = spark.createDataFrame([(v,) for v in odd], "v double")
    out = rows.select(adapters._cents("v", "decimal(18,2)").alias("a"), (F.col("v").cast("decimal(18,2)") * 100).cast("long").alias("b")).collect()
    assert [r["a"] for r in out] == [r["b"] for r in out]
