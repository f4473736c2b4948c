"""Filing and distress queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oddsmith.functions.columns import clean, literal_table, verdict
from oddsmith.functions.held import hold
from oddsmith.functions.shared import shared_folder
from oddsmith.jobs.distress_sql import SQL
from oddsmith.jobs.market import owned, rounded
from oddsmith.operators import distress, filings, resample
from oddsmith.sources import adapters as a
from oddsmith.sources import landed

AS_OF_YEAR = 2002
MIN_TRAIN_YEARS = 1  # the orders cover seven years


def names(spark: SparkSession, d: str) -> DataFrame:
    ticker = F.concat(F.lit("S"), F.lpad(F.col("c_custkey").cast("string"), 5, "0"))
    return a.table(spark, d, "customer").select(F.col("c_custkey").alias("cik"), F.col("c_name").alias("name"), ticker.alias("ticker"))


def panel(spark: SparkSession, d: str) -> DataFrame:
    filed = a.filings(spark, d)
    return filings.panel(a.company_years(filed), filed, names(spark, d), AS_OF_YEAR, years=filed.select("year"))


SCORED_FROM = ("cik", "year", "state", "outcome", "outcome_known")


def feats(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return hold(distress.features(panel(spark, d)).select(*columns or "*"))  # read several times by each job


def scored(spark: SparkSession, d: str) -> DataFrame:
    return distress.walk_forward(feats(spark, d, *SCORED_FROM), min_train_years=MIN_TRAIN_YEARS)


def both_scored(spark: SparkSession, d: str) -> DataFrame:
    """The scored company-years with P(bad exit) of the logistic model beside that of the states, without an exchange."""
    rows = feats(spark, d, *SCORED_FROM, *distress.CONTINUOUS)
    models = distress.yearly_logits(rows, min_train_years=MIN_TRAIN_YEARS)
    return distress.logit_probability(distress.walk_forward(rows, min_train_years=MIN_TRAIN_YEARS), models, "year")


def index_lines(spark: SparkSession, d: str) -> DataFrame:
    """Fixed-width-like index lines, one per order, with all kinds of forms and some broken ciks."""
    form = F.create_map(*[F.lit(x) for x in ("1-URGENT", "10-K", "2-HIGH", "10-K405", "3-MEDIUM", "10-KSB", "4-NOT SPECIFIED", "10-K/A", "5-LOW", "8-K")])
    cik = F.col("o_custkey").cast("string")
    shown = F.when(F.col("o_orderkey") % 11 == 0, F.concat(F.lit("x"), cik)).otherwise(cik)
    file = F.concat(F.lit("edgar/data/"), cik, F.lit("/"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"), F.lit(".txt"))
    name = F.concat(F.lit("HOLDINGS "), cik, F.lit(" INC"))
    orders = a.table(spark, d, "orders")
    return orders.select(F.col("o_orderkey").alias("order_key"), F.col("o_orderdate").cast("date").alias("date"), F.concat_ws("  ", form[F.col("o_orderpriority")], name, shown, F.date_format("o_orderdate", "yyyy-MM-dd"), file).alias("value"))


def submissions_explode(spark: SparkSession, d: str) -> DataFrame:
    rows = a.filings(spark, d)
    packed = rows.groupBy("cik").agg(F.collect_list(F.struct("form", "filing_date", "item")).alias("r"))
    items = F.when(F.col("cik") % 4 == 0, F.array().cast("array<string>")).otherwise(F.col("r.item"))
    return filings.submissions(packed.select("cik", F.col("r.form").alias("form"), F.col("r.filing_date").alias("filing_date"), items.alias("items")))


def put(rows: DataFrame, name: str) -> str:
    """A new shared folder with the text column `value` of `rows`, in a folder for each `file`."""
    path = shared_folder(rows.sparkSession, name)
    (rows.write.partitionBy("file") if "file" in rows.columns else rows.write).text(path)
    return path


def submission_files(spark: SparkSession, d: str) -> DataFrame:
    """Nested submissions, a document a line; those of every 97th company are cut off, every 4th has no items."""
    packed = a.filings(spark, d).groupBy("cik").agg(F.collect_list(F.struct("form", F.col("filing_date").cast("string").alias("filingDate"), "item")).alias("r"))
    items = F.when(F.col("cik") % 4 == 0, F.array().cast("array<string>")).otherwise(F.col("r.item"))
    recent = F.struct(F.col("r.form").alias("form"), F.col("r.filingDate").alias("filingDate"), items.alias("items"))
    whole = F.to_json(F.struct(F.lpad(F.col("cik").cast("string"), 10, "0").alias("cik"), F.struct(recent.alias("recent")).alias("filings")))
    value = F.when(F.col("cik") % 97 == 0, F.substring(whole, 1, 40)).otherwise(whole)
    return landed.landed(spark, put(packed.select(value.alias("value")), "submissions"), landed.SUBMISSION, lines=True)


def landed_submissions(spark: SparkSession, d: str) -> DataFrame:
    return landed.submission_rows(submission_files(spark, d))


def landed_rejects(spark: SparkSession, d: str) -> DataFrame:
    """How many documents can't be read, and how they begin."""
    return landed.rejected(submission_files(spark, d)).groupBy(F.substring("raw", 1, 7).alias("head")).agg(F.count(F.lit(1)).alias("n"))


PAGE = 100  # hits of a page
SEARCH = 9_800  # hits of a search at most, so that it shows all of them and never asks for the page from 9,900 on


def hit_years(spark: SparkSession, d: str) -> DataFrame:
    """cik, year of text searches' pages of `PAGE` hits, a page a line; a page that no search reaches names unknown companies.

    A search covers a day's filings, or a stretch of them if the day has more than `SEARCH`.
    """
    found = a.filings(spark, d).filter("priority = '1-URGENT'")
    nth = F.row_number().over(Window.partitionBy("filing_date").orderBy("order_key")) - 1
    hit = F.struct(F.struct(F.array(F.lpad(F.col("cik").cast("string"), 10, "0"), F.lit("n/a")).alias("ciks")).alias("_source"))
    found = found.select("filing_date", F.floor(nth / SEARCH).alias("stretch"), (F.floor(nth % SEARCH / PAGE) * PAGE).alias("start"), "order_key", hit.alias("h"))
    pages = found.groupBy("filing_date", "stretch", "start").agg(F.transform(F.sort_array(F.collect_list(F.struct("order_key", "h"))), lambda x: x["h"]).alias("hits"))
    stray = F.struct(F.struct(F.array(F.lit("999999999")).alias("ciks")).alias("_source"))
    more = found.select("filing_date", "stretch").distinct().select("filing_date", "stretch", F.lit(9_900).cast("bigint").alias("start"), F.array(stray).alias("hits"))
    name = F.format_string("fts_gc_%s-%d_%d.json", F.date_format("filing_date", "yyyy_MMdd"), "stretch", "start")
    lines = pages.unionByName(more).select(F.to_json(F.struct(name.alias("page"), F.struct("hits").alias("hits"))).alias("value"))
    return landed.hit_years(landed.landed(spark, put(lines, "hits"), landed.HITS, lines=True))


def hit_ciks(spark: SparkSession, d: str) -> DataFrame:
    return hit_years(spark, d).select("cik").distinct()


COMPANIES = 1_000  # of a landed document at most, however many there are


def ticker_map(spark: SparkSession, d: str) -> DataFrame:
    """cik and ticker out of landed objects of numbered entries, an object a line."""
    part = names(spark, d).groupBy(F.floor(F.col("cik") / COMPANIES).alias("g")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("cik").cast("string"), F.struct(F.col("cik").alias("cik_str"), "ticker")))).alias("m"))
    return landed.ticker_map(landed.landed(spark, put(part.select(F.to_json("m").alias("value")), "tickers"), landed.TICKERS, lines=True))


# Panel column, concept, its place in the order, and whether it is a balance at year's end.
CONCEPTS = [
    ("assets", "Assets", 0, True),
    ("liabilities", "Liabilities", 0, True),
    ("equity", "StockholdersEquity", 0, True),
    ("cash", "Cash", 0, True),
    ("revenue", "Revenues", 0, False),
    ("revenue", "SalesRevenueNet", 1, False),
    ("net_income", "NetIncomeLoss", 0, False),
    ("ocf", "NetCashProvidedByUsedInOperatingActivities", 0, False),
    ("current_assets", "AssetsCurrent", 0, True),
    ("current_liabilities", "LiabilitiesCurrent", 0, True),
]
FIGURES = list(dict.fromkeys(c[0] for c in CONCEPTS))


def priority(spark: SparkSession) -> DataFrame:
    return literal_table(spark, [c[:3] for c in CONCEPTS], "column string, concept string, rank int")


def landed_frames(spark: SparkSession, d: str) -> DataFrame:
    """concept, fy, instant, cik, val of JSON frames, a document a line for each concept, fiscal year and `COMPANIES` companies.

    A report filed in a year gives the figures of the year before. Some companies give no Revenues, some no Cash.
    """
    years = a.company_years(a.filings(spark, d))
    gap = {"Revenues": 3, "Cash": 5}
    value = lambda column, concept: F.when(F.col("cik") % gap.get(concept, 1 << 40) != 0, F.col(column)) if concept in gap else F.col(column) / (2 if concept == "SalesRevenueNet" else 1)
    period = lambda instant: F.concat(F.lit("CY"), (F.col("year") - 1).cast("string"), F.lit("Q4I" if instant else ""))
    each = years.select(F.inline(F.array(*[F.struct(F.lit(c).alias("tag"), period(i).alias("ccp"), F.struct(F.col("cik"), value(column, c).alias("val")).alias("fact")) for column, c, _, i in CONCEPTS])))
    frames = each.groupBy("tag", "ccp", F.floor(F.col("fact.cik") / COMPANIES).alias("g")).agg(F.collect_list("fact").alias("data")).select(F.to_json(F.struct("tag", "ccp", "data")).alias("value"))
    return landed.concept_values(landed.landed(spark, put(frames, "frames"), landed.FRAME, lines=True))


def concept_fallback(spark: SparkSession, d: str) -> DataFrame:
    return filings.fallback(landed_frames(spark, d), priority(spark), FIGURES).select("cik", "fy", "assets", "cash", "revenue", "net_income")


def index_files(spark: SparkSession, d: str) -> DataFrame:
    """Numbered index lines of landed files, a folder for each year and quarter, in order of the orders' keys."""
    lines = index_lines(spark, d).withColumns({"year": F.year("date"), "quarter": F.quarter("date")})
    dealt = lines.repartition("year", "quarter").sortWithinPartitions("year", "quarter", "order_key")
    path = shared_folder(spark, "index")
    dealt.select("value", "year", "quarter").write.partitionBy("year", "quarter").text(path)
    return landed.numbered_lines(spark, path, r"/year=(\d{4})/quarter=([1-4])/[^/]*$")


def numbered_index(spark: SparkSession, d: str) -> DataFrame:
    return filings.parsed_index(index_files(spark, d), keep=("year", "quarter", "line_no"))


def landed_panel(spark: SparkSession, d: str) -> DataFrame:
    """The panel end to end, from landed files: index lines, concept frames, hits of a text search, a ticker map; and filings."""
    return filings.landed_panel(numbered_index(spark, d), landed_frames(spark, d), priority(spark), FIGURES, a.filings(spark, d), ticker_map(spark, d), AS_OF_YEAR, hit_years(spark, d), ["quarter", "line_no"])


def exit_classify(spark: SparkSession, d: str) -> DataFrame:
    filed = a.filings(spark, d)
    years = a.company_years(filed)
    rows = filings.survival(years.filter("assets > 0"), years.select("cik", "year"))
    fetched = years.select((F.col("year") - 2).alias("year")).distinct()  # calendar years
    gone = rows.filter(~F.col("files_on") & (F.col("year") + 2 < AS_OF_YEAR)).join(F.broadcast(fetched), "year", "left_semi")
    return filings.exits(gone.select("cik", "year", "first_date"), filed)


def cohort_exits(spark: SparkSession, d: str) -> DataFrame:
    years = a.company_years(a.filings(spark, d))
    return filings.survival(years.filter("assets > 0"), years.select("cik", "year")).select("cik", "year", "files_on")


def final_scores(rows: DataFrame) -> DataFrame:
    """Every company of the latest cohort with the fitted P(outcome) and P(bad exit) of its state."""
    bad = F.sum(F.when(distress.is_bad(), F.col("p")).otherwise(0.0)).alias("p_bad")
    each = [F.max(F.when(F.col("outcome") == o, F.col("p"))).alias(f"p_{o}") for o in distress.OUTCOMES]
    fitted = distress.state_model(rows).groupBy("state").agg(bad, *each)
    newest = rows.agg(F.max("year").alias("year"))  # one row
    return rows.join(F.broadcast(newest), "year").join(F.broadcast(fitted), "state")  # one row per state


def worst_companies(spark: SparkSession, d: str) -> DataFrame:
    rows = rounded(final_scores(feats(spark, d)).select("cik", "name", "state", "p_bad"))
    return rows.orderBy(F.desc("p_bad"), "cik").limit(5)  # a top-5 report


def ticker_distress_join(spark: SparkSession, d: str) -> DataFrame:
    scores = final_scores(feats(spark, d)).filter("ticker <> ''")
    best = scores.groupBy("ticker").agg(F.max("cik").alias("cik"), F.max_by("p_bad", "cik").alias("p_bad"))
    tickers = a.table(spark, d, "lineitem").select(F.concat(F.lit("S"), F.lpad(F.col("l_suppkey").cast("string"), 5, "0")).alias("ticker")).distinct()
    return rounded(tickers.join(best, "ticker", "left"))


def latest_cohort_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = feats(spark, d)
    logit = distress.final_logit(rows)[1]
    each = [f"p_{o}" for o in distress.OUTCOMES]
    return rounded(final_scores(rows).select("cik", "name", "year", "state", "p_bad", *each).join(logit, ["cik", "year"]))


def both_aucs(rows: DataFrame, keys: list[str]) -> DataFrame:
    of = lambda kind: resample.auc(rows, f"p_bad_{kind}", "y_bad", keys).select(*keys, F.col("auc").alias(f"auc_{kind}"))
    return of("state").join(of("logit"), keys) if keys else of("state").join(F.broadcast(of("logit")))


def distress_by_year(spark: SparkSession, d: str) -> DataFrame:
    rows = hold(both_scored(spark, d).select("year", "y_bad", "p_bad_state", "p_bad_logit"))
    means = rows.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.avg("y_bad").alias("bad_rate"))
    return rounded(means.join(both_aucs(rows, ["year"]), "year"))


def distress_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = hold(both_scored(spark, d).select("ll_state", "ll_base", "y_bad", "p_bad_state", "p_bad_logit"))
    means = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"logloss_{k}") for c, k in (("ll_state", "state"), ("ll_base", "base"))], F.avg("y_bad").alias("bad_rate"))
    return rounded(means.join(F.broadcast(both_aucs(rows, []))))  # one row each


def informative_factors(spark: SparkSession, d: str) -> DataFrame:
    kept = distress.informative(panel(spark, d))
    return literal_table(spark, [(f, f in kept) for f in distress.DEFAULT], "factor string, used boolean")


def distress_rollup(spark: SparkSession, d: str) -> DataFrame:
    gain = F.col("ll_base") - F.col("ll_state")
    return rounded(
        scored(spark, d).rollup("year").agg(
            F.count(F.lit(1)).alias("n"), F.avg("ll_state").alias("logloss_state"), F.avg("ll_base").alias("logloss_base"), F.avg(gain).alias("logloss_gain"), F.avg("y_bad").alias("bad_rate")
        )
    )


def interval(spark: SparkSession, d: str) -> DataFrame:
    return resample.block_bootstrap(scored(spark, d), F.col("ll_base") - F.col("ll_state"), "year", 1)


def distress_calibration(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d).withColumn("p", F.round("p_bad_state", 9))
    return rounded(resample.calibration(rows, "p", F.col("y_bad")))


def distress_ratios(spark: SparkSession, d: str) -> DataFrame:
    rows = feats(spark, d).withColumn("runway_years", clean(F.col("runway_years")))
    return rounded(rows.select("cik", "year", "log_assets", "leverage", "cash_ratio", "roa", "ocf_assets", "current_ratio", "runway_years"))


def state_table(spark: SparkSession, d: str) -> DataFrame:
    bad = F.sum(F.when(distress.is_bad(), F.col("p")).otherwise(0.0)).alias("p_bad")
    return rounded(distress.state_model(feats(spark, d)).groupBy("state").agg(F.max("n_state").alias("n_rows"), bad))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    flags = [f"is_{n}" for n in distress.REGISTRY]
    found = {
        "filing_index_parse": lambda s, d: filings.parsed_index(index_lines(s, d)),
        "cohort_first_filing": lambda s, d: filings.cohorts(filings.parsed_index(index_lines(s, d)), ["filing_date", "file"]),
        "index_line_numbers": numbered_index,
        "index_order_cohorts": lambda s, d: filings.cohorts(numbered_index(s, d), ["quarter", "line_no"]),
        "submissions_explode": submissions_explode,
        "landed_submissions": landed_submissions,
        "landed_rejects": landed_rejects,
        "hit_ciks": hit_ciks,
        "ticker_map": ticker_map,
        "concept_fallback": concept_fallback,
        "cohort_exits": cohort_exits,
        "exit_classify": exit_classify,
        "panel_build": panel,
        "panel_meta": lambda s, d: filings.panel_meta(panel(s, d)),
        "text_flag": lambda s, d: filings.text_flag(a.table(s, d, "documents"), ("licensed under", "version"), ["source", "lang"]),
        "outcome_counts": lambda s, d: panel(s, d).filter("outcome_known").groupBy("outcome").agg(F.count(F.lit(1)).alias("n")),
        "outcome_pullback": lambda s, d: filings.pulled_back(panel(s, d)).select("cik", "year", "label"),
        "distress_ratios": distress_ratios,
        "distress_factors": lambda s, d: feats(s, d).select("cik", "year", *flags),
        "distress_state": lambda s, d: feats(s, d).select("cik", "year", "state"),
        "distress_state_model": lambda s, d: rounded(distress.state_model(feats(s, d)).select("state", "outcome", "n", "w", "q", "p")),
        "distress_state_table": state_table,
        "distress_transitions": lambda s, d: rounded(distress.transitions(feats(s, d))),
        "distress_walk_forward": lambda s, d: rounded(both_scored(s, d).select("cik", "year", "state", "outcome", "ll_state", "ll_base", "p_bad_state", "p_bad_base", "p_bad_logit", "y_bad")),
        "distress_by_year": distress_by_year,
        "distress_rollup": distress_rollup,
        "auc_overall": lambda s, d: rounded(resample.auc(scored(s, d), "p_bad_state", "y_bad")),
        "auc_by_year": lambda s, d: rounded(resample.auc(scored(s, d), "p_bad_state", "y_bad", ["year"])),
        "cohort_bootstrap": lambda s, d: rounded(interval(s, d)),
        "distress_verdict": lambda s, d: interval(s, d).select(verdict(F.col("lo"), F.col("hi")).alias("verdict")),
        "distress_calibration": distress_calibration,
        "latest_cohort_scores": latest_cohort_scores,
        "worst_companies": worst_companies,
        "ticker_distress_join": ticker_distress_join,
        "logit_scores": lambda s, d: rounded(distress.logit_scores(feats(s, d), min_train_years=MIN_TRAIN_YEARS).select("cik", "year", "p_bad_logit")),
        "logit_weights": lambda s, d: rounded(distress.final_logit(feats(s, d))[0]),
        "distress_summary": distress_summary,
        "informative_factors": informative_factors,
        "landed_panel": landed_panel,
    }
    return {name: owned(query) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
