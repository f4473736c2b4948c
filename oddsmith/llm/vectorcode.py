"""Compression of vectors to short codes by product quantisation in whole numbers.

Vectors are scaled, floored to integers and cut into equal parts; every part position has a small
codebook, fitted by rounds of exact assignment and integer means. Float32 matrix products screen
the entries: rounding errors are bounded, and every entry whose interval reaches the best one's is
evaluated again in int64, ties going to the smaller index. So codes and codebooks are exact and do
not depend on how the table is partitioned.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ROWS = 8192  # vectors that are screened at once
_LONG = 2**63 - 1


@dataclass(frozen=True)
class Codebooks:
    """`entries[part][index]` are tuples of Python integers; `scale` is what vectors were multiplied by."""

    entries: tuple[tuple[tuple[int, ...], ...], ...]
    dim: int
    scale: int

    def numbers(self) -> list[int]:
        """All components by part, entry and position."""
        return [x for part in self.entries for entry in part for x in entry]


def _limit(dim: int) -> int:
    """Largest component for which squared distances of whole vectors, added up, stay within int64."""
    return math.isqrt(2**62 // dim) // 2


def _exact(x: float, scale: int) -> int:
    """floor(scale * x) of a finite x of any size; `scale` is a power of two."""
    scaled = x * scale
    return math.floor(scaled) if math.isfinite(scaled) else int(x) * scale


def _vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that hold `dim` finite components, and these as float64."""
    lists = column.cast(pa.large_list(column.type.value_type))
    flat = lists.values
    size = np.diff(lists.offsets.to_numpy())
    begin = lists.offsets.to_numpy()[:-1]
    rows = np.flatnonzero((size == dim) & lists.is_valid().to_numpy(zero_copy_only=False))
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)  # null as NaN
    found = values[begin[rows][:, None] + np.arange(dim)] if len(rows) else np.zeros((0, dim))
    good = np.isfinite(found).all(1)
    return rows[good], found[good]


def _int_nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry by exact arithmetic on Python integers."""
    index, far = [], []
    for row in x:
        away = [int(((row - entry) ** 2).sum()) for entry in book]
        far.append(min(away))
        index.append(away.index(far[-1]))
    return np.asarray(index, np.int64), np.asarray(far, object)


def nearest_entries(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Index of the entry nearest to each row; int64 arrays within `_limit`.

    |x - c|^2 differs from |c|^2 - 2 x.c by a term that all entries share. The float32 product of
    d terms with both factors rounded is off by at most (d + 2) u / (1 - (d + 2) u) |x| |c| with
    u = 2 ** -24, in whatever order it is added up; the double steps around it add a few 2 ** -53.
    """
    d, u = x.shape[1], 2.0**-24
    unit = (d + 2) * u / (1 - (d + 2) * u)
    squares = (book * book).sum(1).astype(np.float64)
    sizes = np.sqrt((x.astype(np.float64) ** 2).sum(1))[:, None] * np.sqrt(squares)[None, :] * (1 + 2.0**-40)
    score = squares[None, :] - 2 * (x.astype(np.float32) @ book.astype(np.float32).T).astype(np.float64)
    radius = 2 * unit * sizes + 2.0**-48 * (squares[None, :] + 2 * sizes) + 2.0**-20
    open_ = score - radius <= (score + radius).min(1)[:, None]
    best = score.argmin(1)
    unsure = np.flatnonzero(open_.sum(1) > 1)
    if len(unsure):
        row, entry = np.nonzero(open_[unsure])
        away = x[unsure[row]] - book[entry]
        far = np.full((len(unsure), len(book)), _LONG)
        far[row, entry] = (away * away).sum(1)
        best[unsure] = far.argmin(1)  # the first of equals
    return best


class _Assigner:
    """Codes of float64 vectors under codebooks."""

    def __init__(self, books: Codebooks):
        self.scale, self.limit = books.scale, _limit(books.dim)
        self.objects = [np.array(part, dtype=object) for part in books.entries]
        self.plain = all(abs(v) <= self.limit for v in books.numbers())
        self.books = [part.astype(np.int64) for part in self.objects] if self.plain else []

    def __call__(self, vectors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list]]:
        """Row numbers, integer parts (rows, parts, d), codes (rows, parts) and errors, piece by piece."""
        with np.errstate(over="ignore"):
            scaled = np.floor(vectors * self.scale)
        fits = (np.abs(scaled) <= self.limit).all(1) if self.plain else np.zeros(len(vectors), bool)
        parts = len(self.objects)
        small = np.flatnonzero(fits)
        for at in range(0, len(small), _ROWS):
            rows = small[at : at + _ROWS]
            x = scaled[rows].astype(np.int64).reshape(len(rows), parts, -1)
            codes = np.stack([nearest_entries(np.ascontiguousarray(x[:, p]), book) for p, book in enumerate(self.books)], 1)
            away = x - np.stack([book[codes[:, p]] for p, book in enumerate(self.books)], 1)
            yield rows, x, codes, (away * away).sum((1, 2)).tolist()
        for row in np.flatnonzero(~fits):
            whole = np.array([_exact(v, self.scale) for v in vectors[row].tolist()], dtype=object).reshape(1, parts, -1)
            found = [_int_nearest(whole[:, p], book) for p, book in enumerate(self.objects)]
            yield np.array([row]), whole, np.stack([f[0] for f in found], 1), [sum(int(f[1][0]) for f in found)]


def _narrow(vectors: DataFrame, column: str) -> Column:
    """The vector column as float or double components."""
    kind = vectors.schema[column].dataType
    small = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    return F.col(f"`{column}`") if small else F.col(f"`{column}`").cast("array<double>")


def first_entries(vectors: DataFrame, key: str, column: str, parts: int, entries: int, scale: int) -> Codebooks | None:
    """Codebooks of the vectors of the smallest keys (nulls last, equal keys by vector); None of an empty table."""
    values = vectors.select(F.col(f"`{key}`").alias("k"), _narrow(vectors, column).cast("array<double>").alias("v"))
    values = values.filter(F.col("v").isNotNull() & (F.size("v") > 0) & (F.size("v") % parts == 0))
    values = values.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    order = (F.col("k").asc_nulls_last(), "v")
    one = values.orderBy(*order).limit(1).collect()
    if not one:
        return None
    dim = len(one[0]["v"])
    rows = values.filter(F.size("v") == dim).orderBy(*order).limit(entries).collect()
    whole = [[_exact(x, scale) for x in r["v"]] for r in rows]
    step = dim // parts
    return Codebooks(tuple(tuple(tuple(w[p * step : (p + 1) * step]) for w in whole) for p in range(parts)), dim, scale)


def _totals(vectors: DataFrame, column: str, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """How many parts each entry has, and their sums: one small row a task, added up in a tree."""
    parts, size = len(books.entries), len(books.entries[0])
    step = books.dim // parts

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign = _Assigner(books)
        count, total = np.zeros((parts, size), np.int64), np.zeros((parts, size, step), object)
        for batch in batches:
            for _, x, codes, _ in assign(_vectors(batch.column(0), books.dim)[1]):
                for p in range(parts):
                    count[p] += np.bincount(codes[:, p], minlength=size)
                    if x.dtype == object:
                        total[p, codes[0, p]] += x[0, p]
                    else:  # at most 2 ** 13 rows below 2 ** 31: sums stay within int64
                        added = np.zeros((size, step), np.int64)
                        np.add.at(added, codes[:, p], x[:, p])
                        total[p] += added
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((count, total))], pa.binary())], ["sums"])

    rows = vectors.select(_narrow(vectors, column).alias("v")).mapInArrow(partial, "sums binary").rdd.map(lambda r: pickle.loads(bytes(r[0])))
    return rows.treeReduce(lambda a, b: (a[0] + b[0], a[1] + b[1]))


def fitted(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Codebooks | None:
    """Codebooks after `rounds` of assigning all parts and taking floored means; None if no vector takes part.

    They start as the vectors of the `entries` smallest keys (fewer, if there are fewer). An entry
    that no part is assigned to stays as it is. Vectors that are null or hold null or non-finite
    components take no part, nor do those of another length than the first one's, which is a
    multiple of `parts`. Integers have no upper bound. What reaches the driver are the codebooks
    and sums of that size.
    """
    if not 1 <= entries <= 256 or parts < 1 or scale < 1 or scale & (scale - 1):
        raise ValueError("entries must be 1 to 256, parts positive, scale a power of two")
    books = first_entries(vectors, key, column, parts, entries, scale)
    for _ in range(rounds if books else 0):
        count, total = _totals(vectors, column, books)
        new = tuple(
            tuple(tuple(int(s) // int(n) for s in sums) if n else entry for entry, n, sums in zip(part, count[p], total[p], strict=True))
            for p, part in enumerate(books.entries)
        )
        books = Codebooks(new, books.dim, scale)
    return books


def encoded(vectors: DataFrame, books: Codebooks | None, column: str = "embedding", keep: Iterable[str] | None = None) -> DataFrame:
    """`vectors` that take part, with `code` (binary, a byte a part) and `error`, which replace columns of those names.

    `error` is the squared distance to the entries in scaled integers, null where it is no long.
    `keep` names the columns that stay (default: all).
    """
    names = [c for c in (vectors.columns if keep is None else keep) if c not in ("code", "error")]
    kept = [f"c{i}" for i in range(len(names))]  # plain names inside, whatever the columns are called
    fields = [T.StructField(k, vectors.schema[c].dataType) for k, c in zip(kept, names, strict=True)]
    schema = T.StructType([*fields, T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
    if books is None:
        return vectors.sparkSession.createDataFrame([], schema).toDF(*names, "code", "error")
    columns = [F.col(f"`{c}`").alias(k) for k, c in zip(kept, names, strict=True)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign = _Assigner(books)
        for batch in batches:
            number, found = _vectors(batch.column("__vector"), books.dim)
            for some, _, codes, errors in assign(found):
                out = batch.select(kept).take(pa.array(number[some]))
                code = [c.tobytes() for c in codes.astype(np.uint8)]
                errors = [e if e <= _LONG else None for e in errors]
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(code, pa.binary()), pa.array(errors, pa.int64())], [*kept, "code", "error"])

    return vectors.select(*columns, _narrow(vectors, column).alias("__vector")).mapInArrow(rows, schema).toDF(*names, "code", "error")


def decoded(code: Column, books: Codebooks) -> Column:
    """The approximated vector of a code: the entries' components divided by the scale."""
    table = F.array(*[F.array(*[F.array(*[F.lit(x / books.scale) for x in entry]) for entry in part]) for part in books.entries])
    byte = lambda p: F.conv(F.substring(F.hex(code), 2 * p + 1, 2), 16, 10).cast("int")
    return F.concat(*[table[p][byte(p)] for p in range(len(books.entries))])


def with_group_sum(rows: DataFrame, key: str, column: str, name: str, most: int = 100_000) -> DataFrame:
    """`rows` with the sum of `column` over the rows of equal `key` (nulls together); null where it is no long.

    Sums are added up before they are shuffled. Up to `most` keys they are broadcast; beyond it
    those of keys with a thousandth of all rows or more (a thousand keys at most) are broadcast, so
    no hot key is a shuffle's, and the other rows meet theirs in a shuffled join.
    """
    unknown = F.count_if(F.col(column).isNull()) > 0
    sums = rows.groupBy(F.col(key).alias("__k")).agg(F.when(unknown, None).otherwise(F.try_sum(column)).alias(name), F.count(F.lit(1)).alias("__n"))
    same = F.col(key).eqNullSafe(F.col("__k"))
    if sums.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(sums), same).drop("__k", "__n")
    least = sums.agg(F.sum("__n")).first()[0] / 1000
    hot = sums.filter(F.col("__n") >= least)
    few = rows.join(F.broadcast(hot), same).drop("__k", "__n")
    rest = rows.join(F.broadcast(hot.select("__k")), same, "left_anti")
    return few.unionByName(rest.join(sums.filter(F.col("__n") < least), same).drop("__k", "__n"))
