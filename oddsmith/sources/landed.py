"""Readers of landed files: numbered index lines, and nested JSON with a side table of what can't be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

INDEX_FILE = r"form_(\d{4})_Q([1-4])\.idx$"  # year and quarter
FRAME_FILE = r"frame_([^/]+)_CY(\d{4})(Q4I)?\.json"
HITS_FILE = r"fts_gc_(\d{4})(?:_([^/_]+))?_(\d+)\.json"  # year, part of the year (if its search was split) and number of the first hit
SUBMISSION_FILE = r"sub_(\d+)\.json"

FRAME = "tag string, ccp string, data array<struct<cik:bigint,val:double>>"
SUBMISSION = "cik string, filings struct<recent:struct<form:array<string>,filingDate:array<string>,items:array<string>>>"
HITS = "page string, hits struct<hits:array<struct<_source:struct<ciks:array<string>>>>>"
TICKERS = "map<string,struct<cik_str:bigint,ticker:string>>"

MOST_SPLITS = 500_000  # input splits whose sizes may be broadcast, a hundred bytes each
MOST_HITS = 10_000  # a search shows no hit beyond this one


def numbered_lines(spark: SparkSession, folder: str, shape: str = INDEX_FILE) -> DataFrame:
    """value, year, quarter, line_no of all text files under `folder` whose path has `shape` (two groups: year and quarter).

    Lines are numbered from 1 within their quarter, files of one quarter in order of their names.
    Large files are read in splits by several tasks: a line's number is its place in its split and
    the sizes of the splits before. Only these sizes, one row a split, are added up and joined back,
    so no line is shuffled while there are at most `MOST_SPLITS` splits.
    """
    rows = spark.read.text(folder, recursiveFileLookup=True)
    part = lambda k: F.regexp_extract("file", shape, k).try_cast("int")
    rows = rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"))
    splits = rows.groupBy("file", "split").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    splits = splits.withColumns({"year": part(1), "quarter": part(2)}).filter("year is not null and quarter is not null")
    before = Window.partitionBy("year", "quarter").orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    if splits.limit(MOST_SPLITS + 1).count() <= MOST_SPLITS:
        splits = F.broadcast(splits)
    out = rows.join(splits, ["file", "split"])
    return out.select("value", "year", "quarter", (F.col("base") + F.col("id") - F.col("first") + 1).alias("line_no"))


def landed(spark: SparkSession, folder: str, schema: str, lines: bool = False) -> DataFrame:
    """file, data, raw of all files under `folder`: a JSON document a file, or (`lines`) one a line.

    `data` is null where the text is no document of the schema; `raw` then holds that text. Fields
    that a document lacks are null. `schema` is the fields of a struct, or a map type.
    """
    rows = spark.read.text(folder, wholetext=not lines, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), "value")
    if lines:
        rows = rows.filter(F.trim("value") != "")
    if schema.startswith("map<"):
        data = F.from_json("value", schema)
    else:
        data = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = rows.withColumn("data", data)
    if not schema.startswith("map<"):
        rows = rows.withColumn("data", F.when(F.col("data._bad").isNull() & F.col("data").isNotNull(), F.col("data").dropFields("_bad")))
    return rows.select("file", "data", F.when(F.col("data").isNull(), F.col("value")).alias("raw"))


def accepted(rows: DataFrame) -> DataFrame:
    return rows.filter("data is not null").drop("raw")


def rejected(rows: DataFrame) -> DataFrame:
    """file, raw of the documents that could not be read."""
    return rows.filter("data is null").select("file", "raw")


def write_rejects(rows: DataFrame, path: str, kind: str) -> None:
    """Adds the unreadable documents of one kind to the side table under `path`; those of other kinds stay."""
    out = rejected(rows).select("file", "raw", F.current_timestamp().alias("seen"), F.lit(kind).alias("kind"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind").parquet(path)


def _named(shape: str, group: int, name: Column | str = "file") -> Column:
    return F.regexp_extract(name, shape, group)


def concept_values(rows: DataFrame) -> DataFrame:
    """concept, fy, instant, cik, val of frames. Null values are left out.

    A document's own tag and period (`ccp`) give the concept and the year, or else the file's name. A frame may come
    in several documents, so that none of them grows with the number of companies.
    """
    name = F.coalesce(F.concat(F.lit("frame_"), "data.tag", F.lit("_"), "data.ccp", F.lit(".json")), "file")
    part = lambda k: _named(FRAME_FILE, k, name)
    out = accepted(rows).select(part(1).alias("concept"), part(2).try_cast("int").alias("fy"), (part(3) != "").alias("instant"), F.inline("data.data"))
    return out.filter("concept <> '' and cik is not null and val is not null")


def submission_rows(rows: DataFrame) -> DataFrame:
    """cik, form, filing_date, item of submissions with parallel arrays.

    The cik stands in the document or in the file's name. Absent or empty items are '' for every
    form; otherwise the shortest of the arrays says how many filings there are.
    """
    recent = F.col("data.filings.recent")
    got = accepted(rows).select(F.coalesce(F.col("data.cik").try_cast("bigint"), _named(SUBMISSION_FILE, 1).try_cast("bigint")).alias("cik"), recent.alias("r"))
    n = F.least(F.size("r.form"), F.size("r.filingDate"))
    blank = F.array_repeat(F.lit(""), F.greatest(n, F.lit(0)))
    got = got.filter("cik is not null and r.form is not null and r.filingDate is not null").select("cik", "r", F.when(F.size("r.items") > 0, F.col("r.items")).otherwise(blank).alias("items"))
    most = F.least(F.size("r.form"), F.size("r.filingDate"), F.size("items"))
    cut = lambda c: F.slice(c, F.lit(1), most)
    zipped = F.arrays_zip(cut(F.col("r.form")).alias("form"), cut(F.col("r.filingDate")).alias("filing_date"), cut(F.col("items")).alias("item"))
    out = got.filter(most > 0).select("cik", F.inline(zipped)).toDF("cik", "form", "filing_date", "item")
    return out.select("cik", "form", F.col("filing_date").try_cast("date").alias("filing_date"), F.coalesce("item", F.lit("")).alias("item"))


def hit_years(rows: DataFrame) -> DataFrame:
    """cik, year, each once, of the pages of text searches; what is no number is left out.

    A search covers a year or a part of it, as the page's own name (`page`) or its file's says. Its pages are taken in
    order as it would ask for them: the next page begins where the hits so far end, and an empty or unreadable page
    ends the search, as does `MOST_HITS`. So a year with more hits needs searches of its parts.
    """
    hits = F.coalesce(F.col("data.hits.hits"), F.array().cast("array<struct<_source:struct<ciks:array<string>>>>"))
    part = lambda k: _named(HITS_FILE, k, F.coalesce("data.page", "file"))
    pages = rows.select(part(1).try_cast("int").alias("year"), part(2).alias("part"), part(3).try_cast("long").alias("start"), hits.alias("hits"))
    pages = pages.filter("year is not null and start is not null").withColumn("n", F.size("hits"))
    order = Window.partitionBy("year", "part").orderBy("start")  # a search has at most MOST_HITS pages that count
    expected = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pages = pages.filter(F.col("start") < MOST_HITS).withColumn("fits", F.col("start") == expected)
    reached = F.min(F.col("fits")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    each = pages.withColumn("reached", reached).filter("reached").select("year", F.explode("hits").alias("h"))
    return each.select("year", F.explode("h._source.ciks").alias("c")).select(F.col("c").try_cast("bigint").alias("cik"), "year").filter("cik is not null").distinct()


def ticker_map(rows: DataFrame) -> DataFrame:
    """cik, ticker out of objects of numbered entries; the last entry of a cik wins."""
    each = accepted(rows).select(F.explode("data").alias("k", "v")).filter("v.cik_str is not null")
    return each.groupBy(F.col("v.cik_str").alias("cik")).agg(F.max_by("v.ticker", F.struct(F.col("k").try_cast("bigint"), "k")).alias("ticker"))
