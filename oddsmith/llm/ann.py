"""Nearest neighbours by a blocked matrix join over int8 tiles.

Vectors are quantised to int8 with a scale of their own. A product of two int8 tiles gives
every inner product up to a proven error; only pairs whose upper bound reaches the query's
k-th best lower bound are computed again in double precision, and heaps merge them.
The result is exact: the bounds never drop a pair that belongs to it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from oddsmith.llm.common import written

_QUERIES, _CANDIDATES = 1024, 2048  # rows of a tile


class Block:
    """Vectors with their int8 form: v = scale * code + rest, |rest| in the 2-norm is `error`."""

    def __init__(self, ids: np.ndarray, twins: np.ndarray, vectors: np.ndarray):
        self.ids, self.twins, self.vectors = ids, twins, vectors  # a row is known by its id and its twin number
        most = np.abs(vectors).max(1)
        self.scale = most / 127
        self.scale[self.scale == 0] = 1
        codes = np.rint(vectors / self.scale[:, None])
        # Lengths are taken of vectors brought to size 1, so their squares can't overflow or vanish.
        self.norm = most * np.sqrt(((vectors / most[:, None]) ** 2).sum(1))
        self.error = most * np.sqrt(((vectors / most[:, None] - codes * (self.scale / most)[:, None]) ** 2).sum(1)) + 1e-15 * self.norm
        self.codes = codes.astype(np.int8)


def _tile(q: Block, c: Block) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of all inner products and bounds of their errors, in double precision.

    Vectors far beyond the usual size may make them infinite or undefined; such pairs are computed again.
    """
    kind = np.float32 if q.codes.shape[1] <= 1000 else np.float64  # float32 holds these sums exactly
    with np.errstate(over="ignore", invalid="ignore"):
        product = (q.codes.astype(kind) @ c.codes.T.astype(kind)).astype(np.float64)
        estimate = product * q.scale[:, None] * c.scale
        bound = q.norm[:, None] * c.error + q.error[:, None] * (c.norm + c.error) + 1e-5 * q.norm[:, None] * c.norm + 1e-300
    return estimate, bound


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first component to the last."""
    total = np.zeros(len(q))
    for d in range(q.shape[1]):
        total += q[:, d] * c[:, d]
    return total


class Search:
    """The k best candidates so far of each query of one block."""

    def __init__(self, queries: Block, k: int):
        self.q, self.k = queries, k
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in queries.ids]
        self.least = np.full(len(queries.ids), -np.inf)

    def add(self, c: Block) -> None:
        for lo in range(0, len(self.q.ids), _QUERIES):
            part = slice(lo, lo + _QUERIES)
            q = object.__new__(Block)
            q.__dict__ = {n: v[part] for n, v in self.q.__dict__.items()}
            estimate, bound = _tile(q, c)
            own = (q.ids[:, None] == c.ids) & (q.twins[:, None] == c.twins)
            unsure = ~(np.isfinite(estimate) & np.isfinite(bound))
            with np.errstate(invalid="ignore", over="ignore"):
                low, high = estimate - bound, estimate + bound
            low[own | unsure] = -np.inf
            high[unsure] = np.inf
            floor = self.least[part]
            if len(c.ids) >= self.k:
                floor = np.maximum(floor, np.partition(low, -self.k, axis=1)[:, -self.k])
            rows, cols = np.nonzero((high >= floor[:, None]) & ~own)
            for at in range(0, len(rows), 1 << 18):
                self._merge(lo, rows[at : at + (1 << 18)], cols[at : at + (1 << 18)], q, c)

    def _merge(self, lo: int, rows: np.ndarray, cols: np.ndarray, q: Block, c: Block) -> None:
        score, ids = _exact(q.vectors[rows], c.vectors[cols]), c.ids[cols]
        order = np.lexsort((ids, -score, rows))
        rows, score, ids = rows[order], score[order], ids[order]
        nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
        for r, s, i in zip(*(x[nth < self.k].tolist() for x in (rows, score, ids)), strict=True):
            heap = self.heaps[lo + r]
            if len(heap) < self.k:
                heapq.heappush(heap, (s, -i))
            elif (s, -i) > heap[0]:
                heapq.heapreplace(heap, (s, -i))
        for r in np.unique(rows).tolist():
            if len(self.heaps[lo + r]) == self.k:
                self.least[lo + r] = self.heaps[lo + r][0][0]

    def found(self) -> pa.RecordBatch:
        rows = [(int(q), int(t), -i, s) for q, t, heap in zip(self.q.ids, self.q.twins, self.heaps, strict=True) for s, i in heap]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.float64())], ["query_id", "twin", "vec_id", "score"])


def _usable(vector: Column) -> Column:
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vector.isNotNull() & good & F.exists(vector, lambda x: x != 0)


def _with_twins(rows: DataFrame) -> DataFrame:
    """`rows` (id, v, is_query) with `twin`: 0 where the id occurs once, a number of its own for each row of a repeated id.

    Equal rows are counted and numbered; other rows of one id differ by a hash of their vectors.
    """
    again = rows.groupBy("id").count().filter("count > 1").select("id")
    if again.isEmpty():
        return rows.withColumn("twin", F.lit(0).cast("long"))
    again = written(again, "again")
    equal = rows.join(again, "id", "left_semi").groupBy("id", "v", "is_query").agg(F.count(F.lit(1)).alias("n"))
    each = equal.select("id", "v", "is_query", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("nth"))
    twins = each.select("id", "v", "is_query", F.xxhash64("v", "is_query", "nth").alias("twin"))
    return rows.join(again, "id", "left_anti").withColumn("twin", F.lit(0).cast("long")).unionByName(twins)


def nearest(
    vectors: DataFrame,
    queries: Column,
    k: int = 20,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    query_block: int = 8192,
    least_splits: int = 12,
    candidate_block: int = 1 << 18,
) -> DataFrame:
    """The k rows of largest inner product for every row that `queries` selects, itself left out.

    Columns: query_id, rank (from 1), vec_id, score; ties go to the smaller id. A query with
    fewer candidates gets all of them. Vectors that are null, zero or hold null or non-finite
    components, and rows without an id, take no part; vectors of unequal length are not compared.
    Repeated rows count each: every query row of an id has an answer of its own, in which other rows
    of that id may stand, equal ones too. An empty table gives no rows.

    Cells: a block of queries times a part of the candidates. A cell's queries are held
    in memory (`query_block` vectors), its candidates stream by.
    """
    kind = vectors.schema[vector_column].dataType
    small = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)  # sent as they are, half the bytes
    rows = vectors.select(
        F.col(id_column).cast("long").alias("id"),
        F.col(vector_column).cast(f"array<{'float' if small else 'double'}>").alias("v"),
        F.coalesce(queries, F.lit(False)).alias("is_query"),
    ).filter(F.col("id").isNotNull() & _usable(F.col("v")))
    rows = _with_twins(rows)
    sizes = rows.agg(F.count_if("is_query"), F.count(F.lit(1))).first()
    blocks, splits = max(1, -(-sizes[0] // query_block)), max(least_splits, -(-sizes[1] // candidate_block))
    salted = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(n))
    cell = lambda block, split: F.struct(F.size("v").alias("width"), block.alias("block"), split.alias("split"))
    asked = rows.filter("is_query").withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    asked = asked.select(cell(salted(1, blocks), F.col("split").cast("long")).alias("cell"), F.lit(0).alias("side"), "id", "twin", "v")
    offered = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    offered = offered.select(cell(F.col("block").cast("long"), salted(2, splits)).alias("cell"), F.lit(1).alias("side"), "id", "twin", "v")
    dealt = asked.unionByName(offered).repartition(blocks * splits, "cell").sortWithinPartitions("cell", "side")
    dealt = dealt.select(F.concat_ws("/", "cell.width", "cell.block", "cell.split").alias("cell"), "side", "id", "twin", "v")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asked, at = None, [], None
        for batch in batches:
            cells, sides = batch.column("cell").to_pandas().to_numpy(), batch.column("side").to_numpy()
            cuts = np.flatnonzero((cells[1:] != cells[:-1]) | (sides[1:] != sides[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(cells)], strict=True):
                if hi == lo:
                    continue
                if cells[lo] != cell:
                    if at:
                        yield at.found()
                    cell, asked, at = cells[lo], [], None
                part = batch.slice(lo, hi - lo)
                ids, twins = part.column("id").to_numpy(), part.column("twin").to_numpy()
                values = part.column("v").flatten().to_numpy().reshape(hi - lo, -1)
                if sides[lo] == 0:
                    asked.append((ids, twins, values.astype(np.float64)))
                    continue
                if at is None and asked:
                    at = Search(Block(*(np.concatenate(x) for x in zip(*asked, strict=True))), k)
                for i in range(0, hi - lo, _CANDIDATES) if at else ():
                    some = slice(i, i + _CANDIDATES)
                    at.add(Block(ids[some], twins[some], values[some].astype(np.float64)))
        if at:
            yield at.found()

    best = dealt.mapInArrow(search, "query_id long, twin long, vec_id long, score double")
    order = Window.partitionBy("query_id", "twin").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
