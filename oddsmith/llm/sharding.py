"""Reproducible shuffle into shards: a Feistel permutation of global row numbers.

Rows are numbered by their content, not by where they lie. The permutation maps number to place;
place p lies in shard p mod shards, at slot p div shards. So shard and slot of any row follow
from its number, and `row_number` says which row lies at a shard's slot, without any table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyspark.sql.types as T
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oddsmith.llm.common import text_key, written

ROUNDS = 4
# Odd multipliers of the round function, on 32-bit words.
FIRST, SECOND, STEP = 0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35
_LOW = np.uint64(0xFFFFFFFF)


def halves(n: int) -> tuple[int, int]:
    """Bits of the left and of the right half of the smallest block that holds n numbers."""
    bits = max(2, (max(n, 1) - 1).bit_length())
    if bits > 63:
        raise ValueError("more than 2 ** 63 rows")
    return bits // 2, bits - bits // 2


def _round(half: np.ndarray, key: int, bits: int) -> np.ndarray:
    x = (half * np.uint64(FIRST) + np.uint64(key)) & _LOW
    x = x ^ (x >> np.uint64(15))
    x = (x * np.uint64(SECOND)) & _LOW
    x = x ^ (x >> np.uint64(13))
    return x & np.uint64((1 << bits) - 1)


def _keys(seed: int) -> list[int]:
    return [((seed + r + 1) * STEP) & 0xFFFFFFFF for r in range(ROUNDS)]


def _once(x: np.ndarray, n: int, seed: int, back: bool) -> np.ndarray:
    """One pass of the network over the whole block: even rounds change the left half, odd ones the right."""
    a, b = halves(n)
    left, right = x >> np.uint64(b), x & np.uint64((1 << b) - 1)
    rounds = list(enumerate(_keys(seed)))
    for r, key in reversed(rounds) if back else rounds:
        if r % 2 == 0:
            left = left ^ _round(right, key, a)
        else:
            right = right ^ _round(left, key, b)
    return left << np.uint64(b) | right


def permuted(numbers: np.ndarray, n: int, seed: int = 0, back: bool = False) -> np.ndarray:
    """Places of row numbers 0 to n - 1 (`back`: numbers of places).

    A result of n or more is permuted again until it lies below n (cycle walking); the block has
    fewer than twice n places, or four, so that takes fewer than two passes on average.
    """
    x = np.asarray(numbers).astype(np.uint64)
    if len(x) and int(x.max()) >= n:
        raise ValueError("a number outside the permutation")
    x = _once(x, n, seed, back)
    while len(over := np.flatnonzero(x >= n)):
        x[over] = _once(x[over], n, seed, back)
    return x.astype(np.int64)


def place(number: int, n: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """Shard and slot of a row number."""
    p = int(permuted(np.array([number]), n, seed)[0])
    return p % shards, p // shards


def row_number(shard: int, slot: int, n: int, shards: int, seed: int = 0) -> int:
    """The row number that lies at a shard's slot."""
    return int(permuted(np.array([slot * shards + shard]), n, seed, back=True)[0])


def numbered(rows: DataFrame, order: Iterable[Column]) -> tuple[DataFrame, int]:
    """(row, number): each row as a struct with a gapless number from 0 in `order`; and how many rows there are.

    A range exchange sorts the rows, each partition numbers its own, and the sums of the sizes of
    the partitions before are added: a table of one row a partition. Rows equal in `order` are
    dealt out by where they were read, so a large group of them is no single task's; the sorted
    table is written, so a lost executor changes no number. It stays in the shared folder, as the
    result reads it.
    """
    marked = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.struct(*order, F.monotonically_increasing_id()).alias("at"))
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = marked.repartitionByRange(parts, "at").sortWithinPartitions("at")
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    stored = written(dealt.select("row", F.spark_partition_id().alias("part"), local.alias("nth")), "numbered")
    sizes = stored.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    upto = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("part", F.coalesce(F.sum("size").over(upto), F.lit(0)).alias("base"))  # one row a partition
    total = sizes.agg(F.sum("size")).first()[0] or 0
    return stored.join(F.broadcast(base), "part").select("row", (F.col("base") + F.col("nth")).alias("number")), total


def sharded(docs: DataFrame, shards: int, seed: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with shard (int), slot (long) and row_number (long), which replace columns of those names.

    Shards differ by one row at most, slots have no gaps from 0. Rows are numbered by `key` (nulls
    first), then by a hash of `text` (null behind the empty text), then by a hash of all other columns
    but maps, so the result depends on the rows and the seed alone, not on how the table is laid
    out or read. Rows equal in all that may change places with one another. An empty table stays empty.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    kept = [c for c in docs.columns if c not in ("shard", "slot", "row_number")]
    others = [F.col(f"`{c}`") for c in kept if c not in (key, text) and not isinstance(docs.schema[c].dataType, T.MapType)]
    order = [F.col(f"`{key}`"), *([text_key(f"`{text}`"), F.isnull(f"`{text}`")] if text in kept else []), *([F.xxhash64(*others)] if others else [])]
    rows, n = numbered(docs.select(*[F.col(f"`{c}`") for c in kept]), order)

    def places(numbers: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in numbers:
            yield pd.Series(permuted(some.to_numpy(), n, seed))

    put = F.pandas_udf(places, "long")
    rows = rows.select("row", "number", put("number").alias("place"))
    shard, slot = (F.col("place") % shards).cast("int"), F.expr(f"place div {shards}")
    return rows.select(*[F.col("row").getField(c).alias(c) for c in kept], shard.alias("shard"), slot.cast("long").alias("slot"), F.col("number").alias("row_number"))


def write_shards(rows: DataFrame, path: str) -> None:
    """Parquet, a folder for each shard (shard=0, ...), a shard's rows by slot in one file.

    One task writes one shard, so choose as many shards as keep one within a task's disk.
    """
    shards = rows.agg(F.max("shard")).first()[0]
    dealt = rows.repartitionByRange((shards or 0) + 1, "shard").sortWithinPartitions("shard", "slot")
    dealt.write.mode("overwrite").partitionBy("shard").parquet(path)
