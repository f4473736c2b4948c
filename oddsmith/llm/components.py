"""Connected components of an edge table by alternating stars, without leaving the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsmith.llm.common import dropped, written


def _settled(edges: DataFrame) -> bool:
    """Whether all edges (a, b) are rays of stars: each a has one b, and no b is an a."""
    if not edges.groupBy("a").count().filter("count > 1").isEmpty():
        return False
    return edges.join(edges.select(F.col("b").alias("a")), "a", "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b); root is the least node of its component.

    Each round links the larger neighbours of every node to its least one (large star), then the
    node and its smaller neighbours to the least of these (small star), until only stars are left,
    after a number of rounds that grows with the logarithm of the longest chain.
    Rows of one hot node are only counted by partial aggregation and joined by splittable joins.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _settled(now):
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = written(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        older, now = now, written(small.filter("a <> b").distinct(), "edges")
        dropped(older)
        dropped(large)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
