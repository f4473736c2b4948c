"""Mixing sources to target weights by Poisson replication, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsmith.llm.common import plainly, uniform, written

_SMALL = 10_000  # sources whose rates may be broadcast; beyond it the join is shuffled
_STEP = 200.0  # largest mean that is inverted at once: a larger one is a sum of equal parts


def _cdf(mean: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... until the rest is below any hash's resolution."""
    most = F.ceil(mean + 12 * F.sqrt(mean) + 20).cast("int")
    first = F.exp(-mean)
    grown = F.aggregate(
        F.sequence(F.lit(1), most),
        F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all")),
        lambda acc, k: F.struct(
            (acc["p"] * mean / k).alias("p"),
            (acc["c"] + acc["p"] * mean / k).alias("c"),
            F.concat(acc["all"], F.array(acc["c"] + acc["p"] * mean / k)).alias("all"),
        ),
    )
    return grown["all"]


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5) -> DataFrame:
    """Mean copies of a document for each source: source, n_docs, rate.

    Sources get the share weight / sum of weights of as many documents as there are. Without
    `weights` the weight is (documents of the source) ** `temperature`; a source that `weights`
    does not name gets 0. A null source is a source of its own, named null in `weights`.
    """
    sizes = docs.groupBy(F.col("source").alias("source")).agg(F.count(F.lit(1)).alias("n_docs"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow(F.col("n_docs").cast("double"), F.lit(temperature)))
    else:
        if any(w < 0 for w in weights.values()):
            raise ValueError("weights must not be negative")
        named = F.map_from_arrays(F.array(*[F.lit(k) for k in weights]), F.array(*[F.lit(float(v)) for v in weights.values()])) if weights else F.create_map().cast("map<string,double>")
        sizes = sizes.withColumn("weight", F.coalesce(F.try_element_at(named, F.coalesce(F.col("source").cast("string"), F.lit("null"))), F.lit(0.0)))
    total = sizes.agg(F.sum("n_docs").alias("__docs"), F.sum("weight").alias("__weight"))
    share = F.try_divide(F.col("weight") * F.col("__docs"), F.col("__weight") * F.col("n_docs"))
    return sizes.join(F.broadcast(total)).select("source", "n_docs", F.coalesce(share, F.lit(0.0)).alias("rate"))  # one row


def named(docs: DataFrame, key: str) -> DataFrame:
    """`docs` with `__key`: `key` as text where it is unique, and a text of its own for each other row.

    Rows of null or repeated keys, few as a rule, get a hash of all their columns; equal rows of
    them are counted first and then numbered from 1, so no group of copies is numbered by one task.
    """
    plain = F.col(key).cast("string").alias("__key")
    again = docs.groupBy(F.col(key).alias("__again")).count().filter("count > 1 or __again is null").select("__again")
    if again.isEmpty():
        return docs.select("*", plain)
    again = written(again, "again")
    same = docs[key].eqNullSafe(again["__again"])
    equal = docs.join(again, same, "left_semi").groupBy(*docs.columns).agg(F.count(F.lit(1)).alias("__n"))
    marks = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in docs.columns]
    nth = equal.withColumn("__nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n")))).drop("__n")
    each = F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("null")), F.md5(F.concat_ws(":", *marks)), F.col("__nth").cast("string"))
    return docs.join(again, same, "left_anti").select("*", plain).unionByName(nth.select(*docs.columns, each.alias("__key")))


def mixed(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    temperature: float = 0.5,
    seed: int = 17,
    key: str = "doc_id",
) -> DataFrame:
    """Every document as often as a Poisson number says, all of them in shuffled order.

    The number inverts the Poisson distribution with the source's rate at a hash of the seed and
    `key`, so it is the same in every run. Rows of null or repeated keys have draws of their own,
    by all their columns and their number among equal rows. `copy` counts from 1
    and replaces a column of that name. Rows are dealt over partitions, and ordered within each,
    by another hash. An empty table stays empty; any other columns may be there.
    """
    docs, names = plainly(docs, ("source", key), ("copy",))
    by_source = rates(docs, weights, temperature)
    columns = docs.columns
    docs, key = named(docs, key), "__key"
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / _STEP)).cast("int")
    by_source = by_source.select(
        F.col("source").alias("__source"), parts.alias("__parts"), _cdf(F.col("rate") / parts).alias("__cdf")
    )
    if by_source.limit(_SMALL + 1).count() <= _SMALL:
        by_source = F.broadcast(by_source)
    draws = F.transform(
        F.sequence(F.lit(0), F.col("__parts") - 1),
        lambda i: F.size(F.filter("__cdf", lambda c: c < uniform(F.lit(seed), F.lit("count"), i, F.col(key)))),
    )
    # One number is the usual case: it is compared without an array of draws.
    once = uniform(F.lit(seed), F.lit("count"), F.lit(0), F.col(key))
    joined = docs.join(by_source, docs["source"].eqNullSafe(by_source["__source"]))
    counted = joined.withColumn("__u", once).withColumn(
        "__n",
        F.when(F.col("__parts") == 1, F.size(F.filter("__cdf", lambda c: c < F.col("__u")))).otherwise(F.aggregate(draws, F.lit(0), lambda a, b: a + b)),
    )
    copies = counted.filter("__n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    ordered = copies.withColumn("__order", F.xxhash64(F.lit(seed), F.lit("order"), F.col(key), F.col("copy")))
    return ordered.repartition("__order").sortWithinPartitions("__order").select(*columns, "copy").toDF(*names, "copy")
