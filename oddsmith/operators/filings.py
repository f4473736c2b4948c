"""From filings to the company-year panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Forms that mark an acquisition, the form and item of a bankruptcy, and the annual reports.
ACQUIRED_FORMS = ("DEFM14A", "DEFM14C", "SC TO-T", "SC 13E3")
BANKRUPT_FORM, BANKRUPT_ITEM = "8-K", "1.03"
COHORT_FORMS = ("10-K ", "10-K405 ", "10-KSB ")


def parsed_index(lines: DataFrame, column: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """form, name, cik, filing_date, file of the index lines of annual reports, and the columns `keep` of `lines`.

    Fields are read from the right: file, date, cik; what is left of them is the name. Lines whose
    cik is no number are dropped.
    """
    shape = r"^(\S+)\s+(.*?)\s+(\S+)\s+(\S+)\s+(\S+)\s*$"
    wanted = F.lit(False)
    for form in COHORT_FORMS:
        wanted = wanted | F.col(column).startswith(form)
    part = lambda k: F.regexp_extract(column, shape, k)
    out = lines.filter(wanted).select(
        part(1).alias("form"), part(2).alias("name"), part(3).try_cast("long").alias("cik"), part(4).try_cast("date").alias("filing_date"), part(5).alias("file"), *keep
    )
    return out.filter("cik is not null")


def cohorts(index: DataFrame, order: list[str]) -> DataFrame:
    """cik, year, name, filing_date: the first annual report of a company and year in index order.

    The year is the index's own, if it has one (`landed.numbered_lines`), or else that of the filing date.
    """
    first = F.min_by(F.struct("name", "filing_date"), F.struct(*order)).alias("f")
    year = F.col("year") if "year" in index.columns else F.year("filing_date")
    return index.groupBy("cik", year.alias("year")).agg(first).select("cik", "year", "f.name", "f.filing_date")


def submissions(filed: DataFrame) -> DataFrame:
    """Rows of filings from one row per company with parallel arrays form, filing_date, items; absent items are ''."""
    items = F.when(F.size("items") > 0, F.col("items")).otherwise(F.array_repeat(F.lit(""), F.size("form")))
    zipped = F.arrays_zip(F.col("form"), F.col("filing_date"), items.alias("item"))
    return filed.select("cik", F.inline(zipped)).toDF("cik", "form", "filing_date", "item").withColumn("item", F.coalesce("item", F.lit("")))


def fallback(facts: DataFrame, priority: DataFrame, columns: list[str]) -> DataFrame:
    """One row per (cik, fy): each panel column takes the first concept in order that has a value.

    `priority` (column, concept, rank) is the fixed list of concepts, a few rows a column. A company-year is one
    group of fixed size, whatever the number of its facts, and columns that nobody reads are not carried.
    """
    found = facts.filter("val is not null").join(F.broadcast(priority), "concept")
    of = lambda c, x: F.when(F.col("column") == c, F.col(x))
    return found.groupBy("cik", "fy").agg(*[F.min_by(of(c, "val"), of(c, "rank")).alias(c) for c in columns])


def survival(cohort: DataFrame, years: DataFrame) -> DataFrame:
    """Adds `files_on`: whether the company is in the cohort two or three years later."""
    later = years.select("cik", F.explode(F.array(F.col("year") - 2, F.col("year") - 3)).alias("year")).distinct()
    return cohort.join(later.withColumn("files_on", F.lit(True)), ["cik", "year"], "left").withColumn("files_on", F.coalesce("files_on", F.lit(False)))


def last_signs(filed: DataFrame) -> DataFrame:
    """cik, broke, bought: the last filing of a company that tells of a bankruptcy, and of an acquisition.

    `item` is the text of a filing's items, often a list such as '1.03,9.01'.
    """
    broke = F.col("form").startswith(BANKRUPT_FORM) & F.coalesce(F.col("item").contains(BANKRUPT_ITEM), F.lit(False))
    bought = F.col("form").isin(*ACQUIRED_FORMS)
    last = lambda sign: F.max(F.when(sign, F.col("filing_date")))
    return filed.filter(broke | bought).groupBy("cik").agg(last(broke).alias("broke"), last(bought).alias("bought"))


def _exit() -> Column:
    """How a company has left, by its `last_signs` since `first_date`.

    Bankruptcy comes before acquisition, and that before deregistration, which also stands for no trace.
    """
    since = lambda c: F.coalesce(F.col(c) >= F.col("first_date"), F.lit(False))
    return F.when(since("broke"), "bankrupt").when(since("bought"), "acquired").otherwise("deregistered")


def exits(gone: DataFrame, filed: DataFrame) -> DataFrame:
    """cik, year, exit: how a company that files no more has left; `gone` has one row for each cik and year."""
    return gone.join(last_signs(filed), "cik", "left").select("cik", "year", _exit().alias("exit"))


def panel(company_years: DataFrame, filed: DataFrame, names: DataFrame, as_of_year: int, cohort: DataFrame | None = None, years: DataFrame | None = None) -> DataFrame:
    """The company-year panel: company_years with name, ticker, outcome and outcome_known.

    `names` (cik, name, ticker). `cohort` (cik, year) holds all that filed, also without figures;
    without it the company-years are taken. An outcome is known if the cohort two years later was
    fetched and its year is over; an unknown one is set to filing. Rows without positive assets are left out.
    `years` are the cohort's calendar years, where they are cheaper to have than from the cohort itself.

    Without a cohort, all is worked out along a company's years and joined by cik alone: company-years that come dealt by
    cik are not moved again.
    """
    fetched = next(x for x in (years, cohort, company_years) if x is not None).select((F.col("year") - 2).alias("year"), F.lit(True).alias("fetched")).distinct()
    if cohort is None:
        ahead = F.count(F.lit(1)).over(Window.partitionBy("cik").orderBy("year").rangeBetween(2, 3))
        rows = company_years.withColumn("files_on", (ahead > 0) & F.expr("cik is not null and year is not null")).filter("assets > 0")
    else:
        rows = survival(company_years.filter("assets > 0"), cohort.select("cik", "year").distinct())
    rows = rows.join(F.broadcast(fetched), "year", "left")  # calendar years
    rows = rows.withColumn("outcome_known", F.coalesce("fetched", F.lit(False)) & (F.col("year") + 2 < as_of_year)).drop("fetched")
    out = rows.join(last_signs(filed), "cik", "left").join(names, "cik", "left")
    outcome = F.when(F.col("files_on") | ~F.col("outcome_known"), "filing").when(F.col("cik").isNotNull(), _exit())
    return out.withColumns({"outcome": outcome, "ticker": F.coalesce("ticker", F.lit("")), "name": F.coalesce("name", F.lit(""))}).drop("files_on", "broke", "bought")


def landed_panel(index: DataFrame, facts: DataFrame, priority: DataFrame, columns: list[str], filed: DataFrame, tickers: DataFrame, as_of_year: int, going: DataFrame | None = None, order: Sequence[str] = ("filing_date", "file")) -> DataFrame:
    """The panel from landed files: `parsed_index` lines, concept values, filings and a ticker map.

    `order` are the index's columns that say which of a company's reports of a year comes first.
    A report filed in a year gives the figures of the fiscal year before. `going` (cik, year) is
    the set of companies with doubts about their future; going_concern is null if it was not fetched.
    """
    cohort = cohorts(index, list(order))
    wide = fallback(facts, priority, columns).withColumn("year", F.col("fy") + 1).drop("fy")
    rows = cohort.join(wide, ["cik", "year"]).withColumnRenamed("filing_date", "first_date")
    if going is None:
        rows = rows.withColumn("going_concern", F.lit(None).cast("int"))
    else:
        marked = going.select("cik", "year").distinct().withColumn("going_concern", F.lit(1))
        rows = rows.join(marked, ["cik", "year"], "left").withColumn("going_concern", F.coalesce("going_concern", F.lit(0)))
    out = panel(rows.drop("name"), filed, tickers.withColumn("name", F.lit(None).cast("string")), as_of_year, cohort)
    return out.drop("name").join(cohort.select("cik", "year", "name"), ["cik", "year"])


def text_flag(texts: DataFrame, phrases: tuple[str, str], keys: list[str]) -> DataFrame:
    """The keys of texts that hold both phrases, in any case."""
    low = F.lower("text")
    both: Column = low.contains(phrases[0].lower()) & low.contains(phrases[1].lower())
    return texts.filter(both).select(*keys).distinct()


def panel_meta(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("cik").alias("companies"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def pulled_back(rows: DataFrame) -> DataFrame:
    """Adds `label`: an exit in the very next year replaces this year's outcome `filing`."""
    order = Window.partitionBy("cik").orderBy("year")
    nxt, same = F.lead("outcome").over(order), F.lead("year").over(order) == F.col("year") + 1
    exit_ = nxt.isin("bankrupt", "deregistered", "acquired")
    return rows.withColumn("label", F.when((F.col("outcome") == "filing") & same & exit_, nxt).otherwise(F.col("outcome")))
