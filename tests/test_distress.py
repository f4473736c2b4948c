"""Filings, panel, exits, logistic model and readers."""

import datetime as dt
import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddsmith.functions import held
from oddsmith.jobs import distress as distress_jobs
from oddsmith.operators import distress, filings, resample
from oddsmith.sources import landed, readers

PANEL = (
    "cik long, year int, assets double, liabilities double, equity double, cash double, revenue double, net_income double, ocf double, current_assets double, "
    "current_liabilities double, going_concern int, outcome string, outcome_known boolean, name string, ticker string"
)


def hazard_panel(spark, companies=1500, seed=1):
    """Companies whose yearly exit risk grows with cash burn and negative equity."""
    rng = np.random.default_rng(seed)
    rows = []
    for cik in range(companies):
        weak = rng.random() < 0.35
        for year in range(2010, 2023):
            assets = float(np.exp(rng.normal(17, 1)))
            ocf = assets * float(rng.normal(-0.2 if weak else 0.1, 0.05))
            equity = assets * (-0.1 if weak and rng.random() < 0.6 else 0.4)
            gone = rng.random() < (0.12 if ocf < 0 else 0.02) + (0.1 if equity < 0 else 0)
            outcome = str(rng.choice(["bankrupt", "deregistered", "acquired"], p=[0.4, 0.4, 0.2])) if gone else "filing"
            rows.append((cik, year, assets, assets - equity, equity, assets * 0.1, assets, ocf, ocf, assets * 0.3, assets * 0.2, int(weak and rng.random() < 0.3), outcome, year <= 2020, f"c{cik}", ""))
            if gone:
                break
    return spark.createDataFrame(rows, PANEL)


@pytest.fixture(scope="module")
def panel(spark):
    return distress.features(hazard_panel(spark)).persist()


def test_planted_hazard_is_found(panel):
    rows = distress.walk_forward(panel).persist()
    assert resample.auc(rows, "p_bad_state", "y_bad").first()["auc"] > 0.55
    assert resample.block_bootstrap(rows, F.col("ll_base") - F.col("ll_state"), "year", 1).first()["lo"] > 0


def test_logit_equals_a_plain_fit(panel):
    found = distress.logit_scores(panel).toPandas()
    data = panel.filter("outcome_known").toPandas()
    fold = 2018
    x = data[list(distress.CONTINUOUS)].to_numpy(float)
    x = np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0)
    y = data["outcome"].isin(distress.BAD).to_numpy(float)
    train, test = data["year"] <= fold - 2, data["year"] == fold
    mu, sd = x[train].mean(0), x[train].std(0) + 1e-9
    z = np.column_stack([np.ones(len(x)), np.clip((x - mu) / sd, -5, 5)])
    w, reg = np.zeros(8), np.array([0.0] + [1.0] * 7)
    for _ in range(25):
        p = 1 / (1 + np.exp(-z[train] @ w))
        w -= np.linalg.solve((z[train] * (p * (1 - p))[:, None]).T @ z[train] + np.diag(reg), z[train].T @ (p - y[train]) + reg * w)
    expected = dict(zip(data.loc[test, "cik"], 1 / (1 + np.exp(-z[test] @ w)), strict=True))
    mine = found[found["year"] == fold].set_index("cik")["p_bad_logit"].to_dict()
    assert mine.keys() == expected.keys() and all(abs(mine[k] - v) < 1e-8 for k, v in expected.items())
    assert resample.auc(distress.logit_scores(panel), "p_bad_logit", "y").first()["auc"] > 0.55
    weights, scores = distress.final_logit(panel)
    assert [r["term"] for r in weights.collect()] == ["intercept", *distress.CONTINUOUS] and scores.count() == panel.count()
    assert distress.logit_scores(panel.filter("year < 2012")).count() == 0


def test_ratios_of_missing_and_zero(spark):
    row = (1, 2015, 0.0, 5.0, None, 10.0, None, None, -20.0, None, None, None, "filing", True, "n", "")
    r = distress.features(spark.createDataFrame([row], PANEL)).first()
    assert (r["leverage"], r["runway_years"], r["current_ratio"], r["going_concern"]) == (5.0, pytest.approx(0.5), None, 0)
    assert (r["is_neg_equity"], r["is_loss"], r["is_short_runway"]) == (False, False, True)
    assert r["state"] == "Burning/Runway<1y/PosEquity/NoGC"
    assert distress.features(spark.createDataFrame([(*row[:5], None, *row[6:])], PANEL)).count() == 0


def test_uninformative_going_concern_is_dropped(spark, panel):
    assert distress.informative(panel) == list(distress.DEFAULT)
    assert "going_concern" not in distress.informative(panel.withColumn("going_concern", F.lit(None).cast("int")))


def test_transitions_and_exits(spark):
    base = [100.0, 10.0, 5.0, 50.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0]
    rows = [(1, 2010, *base, "filing", True, "", ""), (1, 2011, *base, "bankrupt", True, "", ""), (2, 2010, *base, "filing", True, "", ""), (2, 2012, *base, "acquired", False, "", "")]
    out = {(r["from_state"], r["to_state"]): r["n"] for r in distress.transitions(distress.features(spark.createDataFrame(rows, PANEL))).filter("n > 0").collect()}
    state = "CashPositive/Runway>1y/PosEquity/NoGC"
    assert out == {(state, state): 1, (state, distress.EXITED): 1}


def test_panel_along_company_years(spark):
    day = lambda y, m=6: dt.date(y, m, 1)
    keys = [(1, 1994), (1, 1997), (2, 1994), (3, 1994), (4, 1994), (4, 1995), (5, 1994), (5, 1996), (6, 1994), (6, 1996), (None, 1994), (None, 1996)]
    years = spark.createDataFrame([(c, y, day(y), 0.0 if (c, y) in ((5, 1994), (6, 1996)) else 1.0) for c, y in keys], "cik long, year int, first_date date, assets double")
    filed = [(2, day(1994), "8-K", "1.03"), (2, day(1995), "DEFM14A", ""), (3, day(1994, 5), "8-K", "1.03"), (3, day(1995), "SC TO-T", None), (None, day(1995), "8-K", "1.03"), (4, None, "8-K", "1.03")]
    filed = spark.createDataFrame(filed, "cik long, filing_date date, form string, item string")
    names = spark.createDataFrame([(1, "ONE", "T1")], "cik long, name string, ticker string")
    for cohort in (None, years):
        rows = filings.panel(years, filed, names, 2002, cohort).collect()
        assert {(r["cik"], r["year"]): (r["outcome"], r["outcome_known"]) for r in rows} == {
            (1, 1994): ("filing", True), (1, 1997): ("filing", False), (2, 1994): ("bankrupt", True), (3, 1994): ("acquired", True), (4, 1994): ("deregistered", True), (4, 1995): ("deregistered", True),
            (5, 1996): ("filing", False), (6, 1994): ("filing", True), (None, 1994): (None, True), (None, 1996): ("filing", False),
        }
        assert len(rows) == 10 and {(r["name"], r["ticker"]) for r in rows if r["cik"] == 1} == {("ONE", "T1")}


def test_scored_company_years_are_dealt_by_company_once(spark):
    held.release(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        panel = distress_jobs.panel(spark, "/root/testdata/sf0.001")
        rows = distress_jobs.both_scored(spark, "/root/testdata/sf0.001")
        for frame in (panel, rows):
            plan = frame._jdf.queryExecution().executedPlan().toString()
            assert not re.search(r"hashpartitioning\(cik#\d+L?, year#", plan)
        assert panel._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 2  # signs and names
        assert rows.count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        held.release(spark)


def test_index_lines(spark):
    lines = ["10-K        EXAMPLE HOLDINGS INC          1234567     2015-03-02  edgar/data/1.txt", "10-K/A  X  1  2015-01-01  f", "10-K405 A B 7 2015-01-02 f", "10-K  BAD  12x 2015-01-01 f", "8-K Y 3 2015-01-01 f", "10-KSB Z 9 2014-05-05 f  "]
    rows = filings.parsed_index(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r["form"], r["name"], r["cik"], str(r["filing_date"])) for r in rows] == [("10-K", "EXAMPLE HOLDINGS INC", 1234567, "2015-03-02"), ("10-K405", "A B", 7, "2015-01-02"), ("10-KSB", "Z", 9, "2014-05-05")]


def test_exit_priority(spark):
    d = lambda y: dt.date(y, 6, 1)
    gone = spark.createDataFrame([(i, 2010, d(2010)) for i in range(8)], "cik long, year int, first_date date")
    filed = [(0, d(2011), "8-K", "1.03,9.01"), (0, d(2011), "DEFM14A", ""), (1, d(2011), "SC TO-T", None), (2, d(2009), "8-K", "1.03"), (3, d(2011), "15-12B", ""), (5, d(2011), "8-K/A", "2.01,1.03"), (6, d(2011), "10-Q", "1.03"), (7, d(2011), "8-K", None)]
    rows = filings.exits(gone, spark.createDataFrame(filed, "cik long, filing_date date, form string, item string")).collect()
    found = {r["cik"]: r["exit"] for r in rows}
    assert found == {0: "bankrupt", 1: "acquired", 5: "bankrupt"} | dict.fromkeys((2, 3, 4, 6, 7), "deregistered")


def test_panel_from_landed_files(spark, tmp_path):
    index = [(cik, f"{y}-03-01", f"f{cik}{y}") for cik, years in ((1, (2010, 2011, 2012, 2013)), (2, (2010,)), (3, (2010, 2011))) for y in years]
    lines = spark.createDataFrame([(f"10-K  NAME {cik}  {cik}  {day}  {file}",) for cik, day, file in index], "value string")
    for concept, kind, values in (("Assets", "Q4I", {1: 5.0, 2: 7.0, 3: None}), ("Revenues", "", {1: None, 2: 3.0}), ("SalesRevenueNet", "", {1: 2.0, 2: 9.0})):
        for year in (2009, 2010, 2011, 2012):
            (tmp_path / f"frame_{concept}_CY{year}{kind}.json").write_text(json.dumps({"data": [{"cik": c, "val": v} for c, v in values.items()]}, indent=1))
    facts = landed.concept_values(landed.landed(spark, str(tmp_path), landed.FRAME))
    assert facts.filter("instant").select("concept").distinct().collect() == [("Assets",)] and facts.filter("val is null").count() == 0
    order = spark.createDataFrame([("assets", "Assets", 0), ("revenue", "Revenues", 0), ("revenue", "SalesRevenueNet", 1)], "column string, concept string, rank int")
    filed = spark.createDataFrame([(2, dt.date(2011, 1, 1), "8-K", "1.03,9.01")], "cik long, filing_date date, form string, item string")
    tickers = spark.createDataFrame([(1, "ONE")], "cik long, ticker string")
    going = spark.createDataFrame([(2, 2010), (2, 2010)], "cik long, year int")
    rows = filings.landed_panel(filings.parsed_index(lines), facts, order, ["assets", "revenue"], filed, tickers, 2014, going)
    found = {(r["cik"], r["year"]): (r["name"], r["ticker"], r["assets"], r["revenue"], r["going_concern"], r["outcome"], r["outcome_known"]) for r in rows.collect()}
    one = lambda known: ("NAME 1", "ONE", 5.0, 2.0, 0, "filing", known)
    assert found == {(1, 2010): one(True), (1, 2011): one(True), (1, 2012): one(False), (1, 2013): one(False), (2, 2010): ("NAME 2", "", 7.0, 3.0, 1, "bankrupt", True)}
    assert filings.landed_panel(filings.parsed_index(lines), facts, order, ["assets", "revenue"], filed, tickers, 2014).first()["going_concern"] is None
    readers.write_panel(rows, str(tmp_path / "out"), "landed", "2020-01-01")
    assert readers.panel(spark, str(tmp_path / "out")).count() == 5
    assert spark.read.json(str(tmp_path / "out" / "meta")).first().asDict() == {"source": "landed", "built": "2020-01-01", "rows": 5, "companies": 2, "years": [2010, 2013]}


def test_auc_counts_ties_as_half(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), float(s), int(y)) for k, s, y in zip(rng.integers(0, 2, 400), rng.integers(0, 60, 400) / 59, rng.random(400) < 0.4, strict=True)] + [(2, 0.5, 1), (0, None, 1)]
    frame = spark.createDataFrame(rows, "k int, s double, y int")
    found = {r["k"]: r["auc"] for r in resample.auc(frame, "s", "y", ["k"]).collect()}
    for k in (0, 1):
        pos, neg = ([s for kk, s, y in rows if kk == k and y == v and s is not None] for v in (1, 0))
        assert found[k] == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)))
    assert found[2] is None


def test_fallback_takes_the_first_known_concept(spark):
    facts = spark.createDataFrame([(1, 2010, "A", None), (1, 2010, "B", 2.0), (2, 2010, "A", 1.0), (2, 2010, "B", 2.0)], "cik long, fy int, concept string, val double")
    order = spark.createDataFrame([("x", "A", 0), ("x", "B", 1)], "column string, concept string, rank int")
    assert {r["cik"]: r["x"] for r in filings.fallback(facts, order, ["x"]).collect()} == {1: 2.0, 2: 1.0}


def test_submissions_without_items(spark):
    rows = spark.createDataFrame([(1, ["8-K", "10-K"], ["a", "b"], []), (2, ["8-K"], ["c"], ["1.03"])], "cik long, form array<string>, filing_date array<string>, items array<string>")
    assert sorted(tuple(r) for r in filings.submissions(rows).collect()) == [(1, "10-K", "b", ""), (1, "8-K", "a", ""), (2, "8-K", "c", "1.03")]


def test_files_in_and_out(spark, tmp_path):
    folder = tmp_path / "universe"
    folder.mkdir()
    (folder / "AAA.csv").write_text("date,close,volume\n" + "".join(f"2020-01-{i:02d},{i},5\n" for i in range(1, 21)))
    (folder / "BBB.csv").write_text("date,close,volume\n2020-01-01,1,1\n")
    (tmp_path / "market.csv").write_text("date,sector_close,vix,tnx\n2020-01-01,1,2,\n")
    (tmp_path / "meta.json").write_text(json.dumps({"source": "s", "tickers": {"AAA": {"first": "2020-01-01", "last": "2020-01-20"}}}))
    rows = readers.universe_prices(spark, str(folder), 10)
    assert rows.count() == 20 and rows.first()["ticker"] == "AAA"
    assert readers.market_series(spark, str(tmp_path / "market.csv")).first()["tnx"] is None
    assert readers.universe_meta(spark, str(tmp_path / "meta.json")).first()["fate"] == "unknown"
    readers.write_prices(rows, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20
    readers.write_results(spark.createDataFrame([(1, float("inf")), (2, 1.5)], "a int, b double"), str(tmp_path / "json"))
    found = {r["a"]: r["b"] for r in spark.read.json(str(tmp_path / "json")).collect()}
    assert found == {1: None, 2: 1.5}
    nested = spark.createDataFrame([([float("nan"), 1.0], (2.0, [float("-inf")]), {"x": float("nan")}), (None, None, None)], "a array<double>, s struct<b:double,c:array<float>>, m map<string,double>")
    readers.write_results(nested, str(tmp_path / "nested"))
    text = "".join(f.read_text() for f in (tmp_path / "nested").glob("*.json"))
    assert "NaN" not in text and "Infinity" not in text and '"s":{"b":2.0' in text
    meta = spark.createDataFrame([("AAA", dt.date(2020, 1, 1), dt.date(2020, 1, 20), "active"), ("BBB", dt.date(2020, 1, 1), dt.date(2020, 1, 2), None)], "ticker string, first date, last date, fate string")
    readers.write_meta(meta, str(tmp_path / "metas"), "s", "2020-02-01")
    again = {r["ticker"]: (r["last"], r["fate"]) for r in readers.universe_meta(spark, str(tmp_path / "metas"), lines=True).collect()}
    assert again == {"AAA": (dt.date(2020, 1, 20), "active"), "BBB": (dt.date(2020, 1, 2), "unknown")}


def _orders(spark, path, rows):
    """orders.parquet of o_orderkey and o_orderdate in `rows`, all urgent and each of a customer of its own."""
    made = rows.select("o_orderkey", F.col("o_orderkey").alias("o_custkey"), F.lit("F").alias("o_orderstatus"), F.lit(100.0).alias("o_totalprice"), "o_orderdate", F.lit("1-URGENT").alias("o_orderpriority"))
    made.write.parquet(f"{path}/orders.parquet")


def test_years_and_days_of_more_hits_than_a_search_shows(spark, tmp_path):
    day = F.when(F.col("id") < 10_500, F.lit(0)).otherwise((F.col("id") % 30).cast("int"))
    _orders(spark, tmp_path, spark.range(12_000).select(F.col("id").alias("o_orderkey"), F.date_add(F.lit("1995-03-01"), day).cast("timestamp").alias("o_orderdate")))
    found = distress_jobs.hit_ciks(spark, str(tmp_path))
    assert found.count() == 12_000
    assert found.agg(F.min("cik"), F.max("cik")).first() == (0, 11_999)


def test_a_panel_marks_every_hit_of_a_year(spark, tmp_path):
    _orders(spark, tmp_path, spark.range(10_500).select(F.col("id").alias("o_orderkey"), F.date_add(F.lit("1995-03-01"), (F.col("id") % 30).cast("int")).cast("timestamp").alias("o_orderdate")))
    spark.range(10_500).select(F.col("id").alias("c_custkey"), F.lit("n").alias("c_name")).write.parquet(f"{tmp_path}/customer.parquet")
    rows = distress_jobs.landed_panel(spark, str(tmp_path)).groupBy("going_concern").count().collect()
    assert [tuple(r) for r in rows] == [(1, 10_500 - len(range(0, 10_500, 11)))]  # a broken cik in every 11th line


def test_landed_documents_stay_small(spark, tmp_path, monkeypatch):
    _orders(spark, tmp_path, spark.range(5_000).select(F.col("id").alias("o_orderkey"), F.lit("1995-03-01").cast("timestamp").alias("o_orderdate")))
    spark.range(5_000).select(F.col("id").alias("c_custkey"), F.lit("n").alias("c_name")).write.parquet(f"{tmp_path}/customer.parquet")
    longest, put = [], distress_jobs.put

    def measured(rows, name):
        longest.append(rows.agg(F.max(F.length("value"))).first()[0])
        return put(rows, name)

    monkeypatch.setattr(distress_jobs, "put", measured)
    facts = distress_jobs.landed_frames(spark, str(tmp_path))
    assert facts.filter("concept = 'Assets' and fy = 1994 and instant").select("cik").distinct().count() == 5_000
    assert facts.filter("not instant").select("concept").distinct().count() == 4
    assert distress_jobs.ticker_map(spark, str(tmp_path)).count() == 5_000
    assert max(longest) < 100_000  # a thousand companies each


def test_concepts_of_a_year_are_one_group(spark):
    facts = spark.createDataFrame([(1, 2010, "B", 2.0), (1, 2010, "A", None), (1, 2011, "A", 1.0), (1, 2011, "B", 2.0), (2, 2010, "C", 3.0)], "cik long, fy int, concept string, val double")
    order = spark.createDataFrame([("x", "A", 0), ("x", "B", 1), ("y", "C", 0)], "column string, concept string, rank int")
    out = filings.fallback(facts, order, ["x", "y"])
    assert sorted(map(tuple, out.collect())) == [(1, 2010, 2.0, None), (1, 2011, 1.0, None), (2, 2010, None, 3.0)]
    assert out.select("cik", "x")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
