"""Column expressions: buckets, business days, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def bucket(r: Column, edges: tuple[float, ...]) -> Column:
    """Number of the half-open interval [edge, next edge) of r; 0 lies below the first edge. Null and NaN give null."""
    out = F.when(r.isNull() | F.isnan(r), F.lit(None).cast("int"))
    for k, edge in enumerate(edges):
        out = out.when(r < edge, F.lit(k))
    return out.otherwise(F.lit(len(edges)))


def business_days_ahead(day: Column, n: int) -> Column:
    """The date n >= 1 business days after `day`; a weekend counts as the Friday before."""
    weekday = F.weekday(day)
    weeks = F.floor((F.least(weekday, F.lit(4)) + n) / 5).cast("int")
    return F.date_add(day, (F.lit(n) + 2 * weeks - F.greatest(weekday - 4, F.lit(0))).cast("int"))


def log_loss(p: Column) -> Column:
    return -F.ln(F.greatest(p, F.lit(1e-12)))


def brier(sum_of_squares: Column, p_actual: Column) -> Column:
    """Sum over classes of (p - [class happened]) ** 2."""
    return sum_of_squares - 2 * p_actual + 1


def clean(x: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def label_state(flags: list[tuple[Column, str, str]]) -> Column:
    """Labels of boolean columns joined by '/'; a null flag has the label of false."""
    return F.concat_ws("/", *[F.when(F.coalesce(f, F.lit(False)), yes).otherwise(no) for f, yes, no in flags])


def verdict(lo: Column, hi: Column) -> Column:
    """What a confidence interval of the gain says."""
    missing = lo.isNull() | hi.isNull() | F.isnan(lo) | F.isnan(hi)
    return F.when(missing, "too little data").when(lo > 0, "better than baseline").when(hi < 0, "worse than baseline").otherwise("indistinguishable from baseline")


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small fixed table as constants of the plan: one task, no Python worker, where it is used."""
    if not rows:
        return spark.createDataFrame([], schema)
    fields = spark.createDataFrame([], schema).schema
    each = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields, strict=True)]) for row in rows]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*each)))
