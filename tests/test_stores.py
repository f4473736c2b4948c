"""The price store, slices of long tickers, sparse fits, payloads and landed files."""

import datetime as dt
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from oddsmith.config import Config
from oddsmith.functions import held
from oddsmith.functions.shared import shared_folder
from oddsmith.jobs import market
from oddsmith.operators import backtest, factors, slices, sparse, universe
from oddsmith.operators import windows as w
from oddsmith.sources import landed, payloads, store

PRICES = "ticker string, date date, close double, volume double"
MARKET = "date date, sector_close double, vix double, tnx double"


def bars(tickers=4, n=420, seed=0, gaps=False):
    rng = np.random.default_rng(seed)
    days = pd.bdate_range("2015-01-01", periods=n)
    rows = []
    for t in range(tickers):
        close = 100 * np.exp(np.cumsum(0.01 * rng.normal(size=n)))
        rows += [(f"T{t}", d.date(), float(c), float(v)) for d, c, v in zip(days, close, rng.integers(1, 100, n), strict=True) if not gaps or rng.random() < 0.9]
    known = lambda x: None if gaps and rng.random() < 0.3 else float(x)
    market = [(d.date(), known(100 + x), known(15 + y), None if i < 5 else known(z)) for i, (d, x, y, z) in enumerate(zip(days, np.cumsum(rng.normal(size=n)), rng.normal(size=n), rng.normal(size=n), strict=True))]
    return rows, market


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def kept(spark):
    path = shared_folder(spark, "prices")
    out = store.PriceStore(spark, "prices_" + path[-32:], path, buckets=4)
    yield out
    out.drop()


# --- store ----------------------------------------------------------------------------------


def test_second_ingest_writes_new_tickers_only(spark, kept):
    rows, _ = bars()
    first = spark.createDataFrame([r for r in rows if r[0] in ("T0", "T1")], PRICES)
    kept.ingest(first)
    files = set(kept.prices().inputFiles())
    more = [(t, d, c + 1000, v) for t, d, c, v in rows] + [("T9", dt.date(2020, 1, 1), None, 1.0), (None, dt.date(2020, 1, 1), 1.0, 1.0), ("T8", None, 1.0, 1.0)]
    kept.ingest(spark.createDataFrame(more, PRICES))
    spark.catalog.refreshTable(kept.name)
    added = [f for f in kept.prices().inputFiles() if f not in files]
    assert files < set(kept.prices().inputFiles())
    assert {r[0] for r in spark.read.parquet(*added).select("ticker").distinct().collect()} == {"T2", "T3"}
    known = {(t, d): c + (1000 if t > "T1" else 0) for t, d, c, _ in rows}
    assert {(r["ticker"], r["date"]): r["close"] for r in kept.prices().collect()} == known
    kept.ingest(first)
    assert kept.prices().count() == len(known)
    kept.compact()
    assert len(kept.prices().inputFiles()) <= kept.buckets
    assert {(r["ticker"], r["date"]): r["close"] for r in kept.prices().collect()} == known
    assert {r["ticker"]: r["n_rows"] for r in kept.tickers().collect()} == dict.fromkeys(("T0", "T1", "T2", "T3"), 420)


def test_windows_over_the_store_need_no_exchange(spark, kept):
    rows, market = bars()
    kept.ingest(spark.createDataFrame(rows, PRICES))
    market = spark.createDataFrame(market, MARKET)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plain = factors.features(spark.createDataFrame(rows, PRICES), market, Config())
        stored = factors.features(kept.prices(), market, Config())
        assert "hashpartitioning(ticker" in plan(plain)
        for df in (stored, kept.tickers(), universe.recent(kept.prices())):
            assert "hashpartitioning(ticker" not in plan(df)
        order = ["ticker", "date"]
        pd.testing.assert_frame_equal(stored.toPandas().sort_values(order, ignore_index=True), plain.toPandas().sort_values(order, ignore_index=True))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_an_empty_ingest(spark, kept):
    kept.ingest(spark.createDataFrame([], PRICES))
    assert kept.prices().count() == 0 and kept.tickers().count() == 0
    kept.ingest(spark.createDataFrame([("A", dt.date(2020, 1, 1), 1.0, None)], PRICES))
    assert kept.prices().count() == 1


# --- slices ---------------------------------------------------------------------------------


@pytest.mark.parametrize(("size", "days", "relative"), [(280, 30, False), (300, 366, True), (5000, 100, False)])
def test_features_in_slices_equal_those_along_tickers(spark, size, days, relative):
    rows, market = bars(3, 900, 5, gaps=True)
    prices, market = spark.createDataFrame(rows + [("SHORT", *r[1:]) for r in rows[:50]], PRICES), spark.createDataFrame(market, MARKET)
    cfg = Config(relative=relative)
    order = ["ticker", "date"]
    one = factors.features(prices, market, cfg).toPandas().sort_values(order, ignore_index=True)
    two = slices.features(prices, market, cfg, size=size, days=days).toPandas().sort_values(order, ignore_index=True)
    assert len(one) > 2000
    pd.testing.assert_frame_equal(one, two, check_exact=False, rtol=1e-9)


def test_slices_hold_their_halo(spark):
    rows = spark.createDataFrame([("A", dt.date(2020, 1, 1) + dt.timedelta(days=i)) for i in range(25)] + [("B", dt.date(2020, 1, 1))], "ticker string, date date")
    cut = slices.sliced(slices.in_periods(rows, 7), 3, 2, 10).orderBy("ticker", "slice", "date").collect()
    day = lambda r: (r["date"] - dt.date(2020, 1, 1)).days
    held_ = {(t, s): [(day(r), r["halo"]) for r in cut if r["ticker"] == t and r["slice"] == s] for t in "AB" for s in range(4)}
    assert held_["A", 0] == [*((i, False) for i in range(10)), (10, True), (11, True)]
    assert held_["A", 1] == [*((i, True) for i in (7, 8, 9)), *((i, False) for i in range(10, 20)), (20, True), (21, True)]
    assert held_["A", 2] == [*((i, True) for i in (17, 18, 19)), *((i, False) for i in range(20, 25))]
    assert held_["A", 3] == [] and held_["B", 0] == [(0, False)] and {r["n_rows"] for r in cut} == {25, 1}
    with pytest.raises(ValueError):
        slices.sliced(slices.in_periods(rows), 30, 2, 10)


def test_one_ticker_of_a_million_rows_goes_to_several_tasks(spark):
    n = 1_000_000
    rows = spark.range(n).select(F.lit("A").alias("ticker"), F.date_add(F.lit(dt.date(1000, 1, 1)), F.col("id").cast("int")).alias("date"), (F.hash("id") % 1000).cast("double").alias("close"))
    cut = slices.sliced(slices.in_periods(rows, 20_000), 251, 0, 16_384)
    done = w.with_medians(cut, {"median": "close"}, 252, ("ticker", "slice")).filter("not halo")
    task = done.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert len(task) >= 3 and sum(r["count"] for r in task) == n and max(r["count"] for r in task) < 0.6 * n
    some = {r["date"]: r["median"] for r in done.filter(F.col("date").between(dt.date(1044, 11, 1), dt.date(1044, 12, 31))).collect()}  # around row 16,384
    first = (min(some) - dt.date(1000, 1, 1)).days - 251
    values = [r[0] for r in rows.filter(F.col("date").between(dt.date(1000, 1, 1) + dt.timedelta(days=first), max(some))).orderBy("date").select("close").collect()]
    assert [some[d] for d in sorted(some)] == pd.Series(values).rolling(252).median().dropna().tolist()


def test_medians_stream_over_batches(spark):
    rows, _ = bars(5, 137, 7)
    prices = spark.createDataFrame([(t, d, None if i % 41 == 0 else c, v) for i, (t, d, c, v) in enumerate(rows)], PRICES)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        out = w.with_medians(prices.withColumn("plain", w.rolling_median("close", 30)), {"quick": "close"}, 30).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(out) == len(rows) and np.allclose(out["plain"], out["quick"], equal_nan=True) and out["quick"].notna().sum() > 100


def test_newest_rows_are_cut_before_the_exchange(spark):
    rows, _ = bars()
    out = universe.recent(spark.createDataFrame(rows, PRICES).repartition(3))
    text = plan(out)
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text[text.index("WindowGroupLimit") :]
    assert text.rindex("WindowGroupLimit") > text.index("hashpartitioning(ticker")


# --- sparse fits ----------------------------------------------------------------------------


def dense(rows, cfg, every):
    """Every key's walk-forward as a plain loop: (ticker, date) -> losses, p_up, ev, period."""
    out = {}
    f = pd.DataFrame(rows, columns=["ticker", "date", "close", "state", "r"])
    f["date"] = pd.to_datetime(f["date"])
    for ticker, own_rows in f.groupby("ticker"):
        known = own_rows[own_rows["state"].notna() & own_rows["r"].notna()].copy()
        known["k"] = np.searchsorted(cfg.edges, known["r"], side="right")
        known["at"] = known["date"] + pd.tseries.offsets.BDay(cfg.horizon)
        days = np.sort(own_rows["date"].unique())
        fits = [d for d in days[::every] if d >= days[0] + pd.Timedelta(days=int(cfg.min_train_years * 365))]
        mine = {}
        for i, t in enumerate(fits):
            train = known[known["at"] <= t]
            if train["state"].nunique() < 2:
                continue
            mean = lambda x: np.array([x.loc[x["k"] == k, "r"].mean() if (x["k"] == k).any() else math.nan for k in range(8)])
            q = np.bincount(train["k"], minlength=8) / len(train)
            base = np.nan_to_num(mean(train))
            for row in known[(known["date"] >= t) & ((known["date"] < fits[i + 1]) if i + 1 < len(fits) else True)].itertuples():
                own = train[train["state"] == row.state]
                weight = len(own) / cfg.horizon / (len(own) / cfg.horizon + cfg.prior_strength)
                p = weight * (np.bincount(own["k"], minlength=8) / len(own) if len(own) else q) + (1 - weight) * q
                m = weight * np.where(np.isnan(mean(own)), base, mean(own)) + (1 - weight) * base
                mine[row.date.date()] = [-math.log(max(p[row.k], 1e-12)), -math.log(max(q[row.k], 1e-12)), p[4:].sum(), (p * m).sum(), (p**2).sum() - 2 * p[row.k] + 1, (q * base).sum()]
        ordered = sorted(mine)
        cut = ordered[math.floor(len(ordered) * (1 - cfg.holdout_fraction))] if ordered else None
        out |= {(ticker, d): [*v, "dev" if d < cut else "holdout"] for d, v in mine.items()}
    return out


def test_sparse_fits_equal_a_loop_over_keys(spark):
    rng = np.random.default_rng(4)
    rows = []
    for ticker, n, labels in (("A", 520, ["HighVIX", "LowVIX"]), ("B", 700, ["HighVIX", "LowVIX"]), ("ONE", 500, ["LowVIX"]), ("NONE", 60, ["HighVIX"])):
        days = pd.bdate_range("2010-01-01", periods=n)
        state = [labels[0] if i < n * 0.7 or rng.random() < 0.5 else labels[-1] for i in range(n)] if ticker == "B" else [labels[int(rng.integers(len(labels)))] for _ in range(n)]
        rows += [(ticker, d.date(), 1.0, None if i % 11 == 0 else s, None if i >= n - 21 else float(0.08 * rng.normal())) for i, (d, s) in enumerate(zip(days, state, strict=True))]
    cfg = Config(factors=("vix_regime",), min_train_years=1, horizon=5)
    feat = spark.createDataFrame(rows, "ticker string, date date, close double, state string, fwd_ret double")
    got = {(r["ticker"], r["date"]): [r[c] for c in ("ll_model", "ll_base", "p_up_model", "ev_model", "brier_model", "ev_base", "period")] for r in backtest.scored(feat, cfg, ["ticker"], 17).collect()}
    expected = dense(rows, cfg, 17)
    assert got.keys() == expected.keys() and {t for t, _ in got} == {"A", "B"} and len(got) > 300
    assert all(np.allclose(got[k][:-1], expected[k][:-1]) and got[k][-1] == expected[k][-1] for k in got)


def test_change_points_are_no_more_than_training_rows(spark):
    days = pd.bdate_range("2010-01-01", periods=400)
    rows = [(t, d.date(), 1.0, "HighVIX" if i < 300 else "LowVIX", 0.01) for t in "AB" for i, d in enumerate(days)]
    cfg = Config(factors=("vix_regime",), min_train_years=1, horizon=5)
    feat = spark.createDataFrame(rows, "ticker string, date date, close double, state string, fwd_ret double")
    attached = backtest.attached(feat, cfg, ["ticker"], 1)
    changes = sparse.change_points(attached, cfg, ["ticker"])
    grid = attached.select("ticker", "test_fit").distinct().count() * 2 * 8
    n = changes.count()
    assert n <= attached.filter("train_fit is not null").count() and n < grid / 10


# --- payloads -------------------------------------------------------------------------------


def test_only_changed_payloads_are_replaced(spark, tmp_path):
    schema = "ticker string, price double, flags map<string,boolean>, history array<struct<date:date,close:double>>, own struct<probs:array<double>,n:bigint>"
    row = lambda t, p: (t, p, {"a": True}, [(dt.date(2020, 1, 1), p), (dt.date(2020, 1, 2), None)], ([0.25, p], 3))
    path = str(tmp_path / "cards")
    first = spark.createDataFrame([row("A", 0.1), row("B B/x", 1 / 3), row("C", math.inf)], schema)
    payloads.replace(first, path)
    before = {f: (tmp_path / "cards" / f).stat().st_mtime_ns for f in sorted(p.name for p in (tmp_path / "cards").glob("ticker=*"))}
    assert len(before) == 3
    payloads.replace(spark.createDataFrame([row("A", 0.1), row("B B/x", 2.5), row("D", 4.0)], schema), path)
    found = {r["ticker"]: r for r in payloads.stored(spark, path, first.schema).collect()}
    assert {t: r["price"] for t, r in found.items()} == {"A": 0.1, "B B/x": 2.5, "C": None, "D": 4.0}
    assert found["A"]["history"] == [(dt.date(2020, 1, 1), 0.1), (dt.date(2020, 1, 2), None)] and found["C"]["own"]["probs"] == [0.25, None] and found["A"]["flags"] == {"a": True}
    after = {f: (tmp_path / "cards" / f).stat().st_mtime_ns for f in before}
    assert [f for f in before if after[f] != before[f]] == ["ticker=B B%2Fx"]


def test_payloads_of_many_keys_share_folders(spark, tmp_path):
    schema = "ticker string, price double, history array<struct<date:date,close:double>>"
    row = lambda t, p: (t, p, [(dt.date(2020, 1, 1), p), (dt.date(2020, 1, 2), None)])
    path, names = str(tmp_path / "cards"), [f'T"{k}/x' for k in range(400)]
    first = spark.createDataFrame([*(row(t, float(k)) for k, t in enumerate(names)), row(None, 0.5), row("", math.inf)], schema)
    payloads.replace(first, path, groups=8)
    files = lambda: {p.parent.name: p.name for p in (tmp_path / "cards").glob("*/*.txt")}
    before = files()
    assert len(before) == len(list((tmp_path / "cards").glob("*/*.txt"))) == 8
    payloads.replace(first.filter("ticker is null or ticker < 'T\"2'"), path, groups=8)  # the same values
    assert files() == before
    payloads.replace(spark.createDataFrame([row(names[7], 7.0), row(names[8], -8.0)], schema), path, groups=8)
    found = payloads.stored(spark, path, first.schema)
    got = {r["ticker"]: (r["price"], r["history"]) for r in found.collect()}
    want = {t: (float(k) if k != 8 else -8.0, [(dt.date(2020, 1, 1), float(k) if k != 8 else -8.0), (dt.date(2020, 1, 2), None)]) for k, t in enumerate(names)}
    want |= {None: (0.5, [(dt.date(2020, 1, 1), 0.5), (dt.date(2020, 1, 2), None)]), "": (None, [(dt.date(2020, 1, 1), None), (dt.date(2020, 1, 2), None)])}
    assert found.columns == first.columns and found.count() == 402 and got == want
    assert len([f for f in before if files()[f] != before[f]]) == 1
    for other in (4, None):
        with pytest.raises(ValueError, match="other folders"):
            payloads.replace(first, path, groups=other)


def test_histories_need_few_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(market, "shared_folder", lambda spark, name: str(tmp_path / name))
    monkeypatch.setattr(market, "FOLDER", 30)
    assert market.stored_history(spark, "/root/testdata/sf0.01").count() == 50_410
    assert len(list((tmp_path / "payloads").glob("*=*"))) == 4  # for 100 tickers


def test_what_jobs_leave_can_be_cleared(spark):
    from oddsmith.functions.shared import clear

    other = spark.newSession()
    path, own = shared_folder(other, "left"), shared_folder(spark, "own")
    for p in (path, own):
        spark.range(3).write.parquet(p)
    clear(other)
    assert spark.read.parquet(own).count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_release_keeps_to_its_session(spark):
    other = spark.newSession()
    mine, theirs = held.hold(spark.range(3)), held.hold(other.range(4))
    held.release(other)
    assert mine.storageLevel.useMemory and not theirs.storageLevel.useMemory
    held.release(spark)
    assert not mine.storageLevel.useMemory


# --- landed files ---------------------------------------------------------------------------


def test_lines_are_numbered_across_splits(spark, tmp_path):
    sizes = {(2010, 1): 4000, (2010, 2): 1, (2011, 1): 900}
    for (year, quarter), n in sizes.items():
        (tmp_path / f"form_{year}_Q{quarter}.idx").write_text("".join(f"line {i} {'x' * (i % 50)}\n" for i in range(1, n + 1)))
    (tmp_path / "readme.txt").write_text("no index\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 10_000)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        rows = landed.numbered_lines(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 5
        found = rows.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(found) == sum(sizes.values())
    assert all(r["value"].split()[1] == str(r["line_no"]) for r in found)
    assert {(r["year"], r["quarter"]) for r in found} == set(sizes)


def test_malformed_documents_go_to_the_side_table(spark, tmp_path):
    sub = lambda **k: json.dumps({"filings": {"recent": k}}, indent=1)
    folder = tmp_path / "sub"
    folder.mkdir()
    (folder / "sub_7.json").write_text(sub(form=["8-K", "10-K", "15"], filingDate=["2011-01-01", "bad", "2012-01-01"], items=["1.03", None, ""]))
    (folder / "sub_8.json").write_text(sub(form=["8-K", "X"], filingDate=["2011-01-01", "2011-02-01"], items=[]))
    (folder / "sub_9.json").write_text(sub(form=["8-K", "X"], filingDate=["2011-01-01", "2011-02-01"], items=["a"]))
    (folder / "sub_10.json").write_text('{"filings": {"recent": {"form": ["8-K"')
    (folder / "sub_11.json").write_text("<html>no</html>")
    (folder / "sub_12.json").write_text('{"cik": "0000000099", "filings": {"recent": {}}}')
    rows = landed.landed(spark, str(folder), landed.SUBMISSION)
    found = sorted(map(tuple, landed.submission_rows(rows).collect()), key=str)
    d = lambda y, m=1: dt.date(y, m, 1)
    assert found == sorted([(7, "8-K", d(2011), "1.03"), (7, "10-K", None, ""), (7, "15", d(2012), ""), (8, "8-K", d(2011), ""), (8, "X", d(2011, 2), ""), (9, "8-K", d(2011), "a")], key=str)
    landed.write_rejects(rows, str(tmp_path / "bad"), "submissions")
    landed.write_rejects(rows, str(tmp_path / "bad"), "submissions")
    assert sorted(r["raw"][:4] for r in spark.read.parquet(str(tmp_path / "bad")).collect()) == ["<htm", '{"fi']


def test_pages_of_hits_are_merged_in_order(spark, tmp_path):
    page = lambda *ciks: json.dumps({"hits": {"hits": [{"_source": {"ciks": list(c)}} for c in ciks]}})
    files = {
        "2010_0": page(["1", "x"], ["2"]), "2010_2": page(["2", "3"]), "2010_3": page(), "2010_9": page(["66"]),
        "2011_0": page(["4"]), "2011_5": page(["66"]), "2012_0": "{broken", "2012_1": page(["66"]), "2013_1": page(["66"]),
    }
    for name, text in files.items():
        (tmp_path / f"fts_gc_{name}.json").write_text(text)
    found = {tuple(r) for r in landed.hit_years(landed.landed(spark, str(tmp_path), landed.HITS)).collect()}
    assert found == {(1, 2010), (2, 2010), (3, 2010), (4, 2011)}


def test_the_last_ticker_of_a_cik_wins(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({str(i): {"cik_str": c, "ticker": t} for i, (c, t) in enumerate([(1, "A"), (2, "B"), *[(3, f"C{k}") for k in range(9)]])}))
    (tmp_path / "u.json").write_text("[1, 2")
    rows = landed.landed(spark, str(tmp_path), landed.TICKERS)
    assert {tuple(r) for r in landed.ticker_map(rows).collect()} == {(1, "A"), (2, "B"), (3, "C8")}
    assert landed.rejected(rows).count() == 1
