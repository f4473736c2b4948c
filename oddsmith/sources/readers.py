"""Readers of landed files: text, CSV and JSON in, typed tables out, and the sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

PRICE_SCHEMA = "date date, close double, volume double"
VENDOR_SCHEMA = "date date, open double, high double, low double, close double, volume double, openint double"
META_SCHEMA = "source string, built string, tickers map<string, struct<first:date,last:date,fate:string,delisted_date:date>>"


def _named_by_file(df: DataFrame, suffix: str) -> DataFrame:
    return df.withColumn("ticker", F.upper(F.regexp_extract(F.col("_metadata.file_name"), rf"^([^/]+?){suffix}$", 1)))


def universe_prices(spark: SparkSession, folder: str, least_rows: int = 300) -> DataFrame:
    """ticker, date, close, volume of all `TICKER.csv` files; files that start with _ are no prices."""
    rows = spark.read.schema(PRICE_SCHEMA).option("header", True).csv(f"{folder}/[!_]*.csv")
    return enough(_named_by_file(rows.select("*", "_metadata"), r"\.csv").select("ticker", "date", "close", "volume"), least_rows)


def market_series(spark: SparkSession, path: str) -> DataFrame:
    """date, sector_close, vix, tnx. Spark hides files named _..., so landed ones need another name."""
    return spark.read.schema("date date, sector_close double, vix double, tnx double").option("header", True).csv(path)


def universe_meta(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """ticker, first, last, fate, delisted_date from the JSON map of a universe; `lines`: one map a line."""
    rows = spark.read.schema(META_SCHEMA).option("multiLine", not lines).json(path)
    return rows.select(F.explode("tickers").alias("ticker", "m")).select("ticker", "m.*").withColumn("fate", F.coalesce("fate", F.lit("unknown")))


def enough(rows: DataFrame, least_rows: int) -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy("ticker"))
    return rows.withColumn("__n", n).filter(F.col("__n") >= least_rows).drop("__n")


def vendor_rows(lines: DataFrame, allowed: DataFrame | None = None, least_rows: int = 300) -> DataFrame:
    """ticker, date, close, volume of OHLCV lines (ticker, value); only tickers in `allowed`, if given."""
    rows = lines.join(allowed, "ticker", "left_semi") if allowed is not None else lines
    rows = rows.select("ticker", F.from_csv("value", VENDOR_SCHEMA).alias("r")).select("ticker", "r.date", "r.close", "r.volume")
    return enough(rows.filter("close is not null"), least_rows)


def eod_rows(lines: DataFrame) -> DataFrame:
    """ticker, date, close, volume of JSON rows; the adjusted close is preferred."""
    rows = lines.select("ticker", F.from_json("value", "date date, close double, volume double, adjClose double").alias("r"))
    return rows.select("ticker", "r.date", F.coalesce("r.adjClose", "r.close").alias("close"), "r.volume")


def ticker_list(lines: DataFrame) -> DataFrame:
    """symbol, name of lines `SYM` or `SYM, Name`; blank lines and # comments are skipped."""
    line = F.trim("value")
    parts = F.split(line, ",", 2)
    symbol = F.upper(F.trim(parts[0]))
    name = F.trim(F.get(parts, F.lit(1)))
    kept = lines.filter((line != "") & ~line.startswith("#"))
    return kept.select(symbol.alias("symbol"), F.coalesce(F.when(name != "", name), symbol).alias("name"))


def long_prices(wide: DataFrame, symbols: list[str], least_rows: int) -> DataFrame:
    """symbol, date, close of a table with a column per symbol; symbols with too few closes are left out."""
    rows = wide.unpivot("date", symbols, "symbol", "close").filter("close is not null")
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    return rows.withColumn("__n", n).filter(F.col("__n") >= least_rows).select("symbol", "date", "close")


def wide_market(rows: DataFrame, symbols: list[str]) -> DataFrame:
    return rows.groupBy("date").pivot("symbol", symbols).agg(F.first("close"))


def search(rows: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows with the text in one of the columns, in any case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(c).contains(text.lower())
    return rows.filter(hit)


def write_prices(rows: DataFrame, path: str) -> None:
    """Parquet with each ticker's rows together and in date order; rows without a close are dropped."""
    rows.filter("close is not null").repartition("ticker").sortWithinPartitions("ticker", "date").write.mode("overwrite").parquet(path)


def write_meta(meta: DataFrame, path: str, source: str, built: str) -> None:
    """One JSON map a line: source, built, and a ticker's first, last, fate (and delisted_date, if known)."""
    known = [c for c in ("first", "last", "fate", "delisted_date") if c in meta.columns]
    tickers = F.create_map(F.col("ticker"), F.struct(*known)).alias("tickers")
    meta.select(F.lit(source).alias("source"), F.lit(built).alias("built"), tickers).write.mode("overwrite").json(path)


def write_panel(rows: DataFrame, path: str, source: str, built: str) -> None:
    """The panel as Parquet under `path`/panel, and one line of JSON about it under `path`/meta."""
    rows.write.mode("overwrite").parquet(f"{path}/panel")
    about = rows.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("cik").alias("companies"), F.array(F.min("year"), F.max("year")).alias("years"))
    about.select(F.lit(source).alias("source"), F.lit(built).alias("built"), "*").write.mode("overwrite").json(f"{path}/meta")


def panel(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/panel")


def finite(column: Column, kind: T.DataType) -> Column:
    """`column` with null for NaN and infinities, at any depth of structs, arrays and map values."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(column) | (F.abs(column) == float("inf")), None).otherwise(column)
    if isinstance(kind, T.StructType):
        return F.when(column.isNotNull(), F.struct(*[finite(column[f.name], f.dataType).alias(f.name) for f in kind]))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: finite(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(column, lambda _, v: finite(v, kind.valueType))
    return column


def write_results(rows: DataFrame, path: str) -> None:
    """JSON lines; NaN and infinities become null, in nested values too."""
    rows.select(*[finite(F.col(f.name), f.dataType).alias(f.name) for f in rows.schema]).write.mode("overwrite").json(path)
