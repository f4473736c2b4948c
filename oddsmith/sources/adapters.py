"""The tables of the jobs, derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(column: str, kind: str) -> Column:
    """`column` as a decimal of two places, in whole hundredths; a double next to such a number needs no decimal."""
    near = F.rint(F.col(column) * 100)
    sure = (F.abs(F.col(column)) < 1e10 if kind == "decimal(18,2)" else F.abs(F.col(column)) < 99) & (F.abs(F.col(column) * 100 - near) < 1e-4)
    return F.when(sure, near.cast("long")).otherwise((F.col(column).cast(kind) * 100).cast("long"))


def _total(column: str, kind: str) -> Column:
    """Sum of money, exact, so that the order of the rows doesn't matter."""
    return F.sum(_cents(column, kind)) / F.lit(100.0)


def _mean(column: str, kind: str) -> Column:
    return _total(column, kind) / F.count(F.lit(1))


def _close() -> Column:
    return 100 + 100 * _mean("l_discount", "decimal(4,2)") + _mean("l_extendedprice", "decimal(18,2)") / 20000


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, date, close, volume: one row per supplier and shipping day. Every fifth ticker ends in 1999.

    Lines are dealt by ticker first: daily sums and all windows along a ticker then need no other exchange.
    """
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_shipdate").cast("date").alias("date"), "l_discount", "l_extendedprice", "l_quantity")
    rows = rows.filter((F.col("l_suppkey") % 5 != 0) | (F.col("date") < "2000-01-01"))
    ticker = F.concat(F.lit("S"), F.lpad(F.col("l_suppkey").cast("string"), 5, "0"))
    daily = rows.withColumn("ticker", ticker).repartition("ticker").groupBy("ticker", "l_suppkey", "date").agg(_close().alias("close"), _total("l_quantity", "decimal(18,2)").alias("volume"))
    return daily.select("ticker", "date", "close", "volume")


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, sector_close, vix, tnx: one row per calendar day on which anything is known."""
    ships = table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date"))
    ships = ships.agg(_close().alias("sector_close"), (10 + 250 * _mean("l_tax", "decimal(4,2)")).alias("vix"))
    rates = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date"))
    rates = rates.agg((_mean("o_totalprice", "decimal(18,2)") / 100000).alias("tnx"))
    return ships.join(rates, "date", "full")


def meta(daily: DataFrame, gap_days: int = 30) -> DataFrame:
    """ticker, first, last, fate: delisted if the last price lies more than `gap_days` before the newest one."""
    spans = daily.groupBy("ticker").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    newest = spans.agg(F.max("last").alias("newest"))  # one row
    fate = F.when(F.datediff("newest", "last") > gap_days, "delisted").otherwise("active")
    return spans.join(F.broadcast(newest)).select("ticker", "first", "last", fate.alias("fate"))


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cik, filing_date, year, form, item, money columns: one filing per order.

    Items come alone and in lists, and some filings that are no 8-K name the item of a bankruptcy.
    """
    orders = table(spark, sf_dir, "orders")
    key, broke = F.col("o_orderkey"), (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")
    form = F.when((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "2-HIGH"), "DEFM14A").when(broke & (key % 5 == 0), "10-Q").when(key % 3 == 0, "8-K/A").otherwise("8-K")
    item = F.when(broke, F.when(key % 2 == 0, "1.03,9.01").when(key % 7 == 0, "2.01,1.03").otherwise("1.03")).otherwise("8.01,9.01")
    return orders.select(
        F.col("o_orderkey").alias("order_key"),
        F.col("o_custkey").alias("cik"),
        F.col("o_orderdate").cast("date").alias("filing_date"),
        F.year("o_orderdate").alias("year"),
        form.alias("form"),
        item.alias("item"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        _cents("o_totalprice", "decimal(18,2)").alias("cents"),
    )


def company_years(filed: DataFrame) -> DataFrame:
    """cik, year, first_date and the money columns of the company-year panel.

    Filings are dealt by company first: all that looks along a company's years then needs no other exchange.
    Money is summed in whole hundredths.
    """
    t = F.col("cents")
    total = lambda cond: F.sum(F.when(cond, t))
    as_double = lambda factor, c: factor * (c / F.lit(100.0))
    none = F.lit(0).cast("long")
    open_, paid = F.col("status") == "O", F.col("status") == "F"
    signed = F.when(F.col("order_key") % 2 == 0, t).otherwise(-t)
    income = F.when(paid, t).when(open_, -t)
    return filed.repartition("cik").groupBy("cik", "year").agg(
        F.min("filing_date").alias("first_date"),
        as_double(200, F.sum(t)).alias("assets"),
        as_double(200, F.coalesce(total(~paid), none)).alias("liabilities"),
        as_double(200, F.coalesce(total(paid), none) - 5_000_000).alias("equity"),
        as_double(60, F.coalesce(total(F.col("priority").isin("1-URGENT", "2-HIGH")), none)).alias("cash"),
        as_double(160, F.sum(t)).alias("revenue"),
        as_double(20, F.sum(income)).alias("net_income"),
        as_double(100, F.sum(signed)).alias("ocf"),
        as_double(80, F.sum(t)).alias("current_assets"),
        as_double(100, total(F.col("status") == "P")).alias("current_liabilities"),
        F.max(((F.col("priority") == "1-URGENT") & paid).cast("int")).alias("going_concern"),
    )
