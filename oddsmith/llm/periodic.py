"""Periodic runs of words: stretches that repeat a block of words over and over.

Suffix array and longest common prefixes of the words give the longest previous factor of every
position, and these give the Lempel-Ziv blocks. A run that touches a block's edge is found by
extending the edge to both sides for every period that can occur there (Main); a run inside a
block is a copy of one found before (buckets by start). All texts of a batch go through the array
steps together; words of different texts never match.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddsmith.llm.common import slices
from oddsmith.llm.textvec import raw

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Number of each word in a dictionary, the n + 1 word offsets of the rows, and the dictionary.

    Words are runs of bytes other than space and \\t..\\r. Equal numbers mean equal words.
    """
    data, offsets = raw(texts)
    space = _SPACE[data]
    first = ~space
    last = first.copy()
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    edge = np.unique(offsets[(offsets > 0) & (offsets < len(data))])
    first[edge] = ~space[edge]
    last[edge - 1] = ~space[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    letters, bounds = data[~space], np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(letters)])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(), np.searchsorted(starts, offsets), coded.dictionary


class Suffixes:
    """Suffix array of rows of words, and the ranks of all stretches of 1, 2, 4, ... words.

    A rank is the first place of its group in the suffix array, so equal ranks at level k mean
    equal stretches of 2 ** k words within one row. `levels` end where all stretches differ; each
    has one more element, -1, for places behind the last word.
    """

    def __init__(self, words: np.ndarray, begin: np.ndarray):
        n = self.n = len(words)
        self.row = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
        self.start, end = begin[self.row], begin[self.row + 1]
        key = self.row * (int(words.max(initial=0)) + 1) + words
        self.array = np.argsort(key, kind="stable")
        self.levels: list[np.ndarray] = []
        rank = np.full(n + 1, -1, np.int32)
        slots, key = np.arange(n), key[self.array]
        width = 1
        while len(slots):
            new = np.ones(len(slots), bool)
            new[1:] = key[1:] != key[:-1]
            head = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
            rank = rank.copy()
            rank[self.array[slots]] = head
            self.levels.append(rank)
            alone = new & np.append(new[1:], True)
            slots = slots[~alone]  # places of suffixes that still have an equal
            at = self.array[slots]
            then = np.where(at + width < end[at], rank[np.minimum(at + width, n)].astype(np.int64) + 1, 0)
            key = rank[at].astype(np.int64) * (n + 2) + then
            order = np.argsort(key, kind="stable")
            self.array[slots], key = at[order], key[order]
            width *= 2

    def _reach(self, equal, n: int) -> np.ndarray:
        """How far two places agree, from `equal(level, chosen, far)`: whether the next 2 ** level words do."""
        top = np.full(n, -1, np.int64)
        chosen, zero = np.arange(n), np.zeros(n, np.int64)
        for k in range(len(self.levels)):
            chosen = chosen[equal(k, chosen, zero[chosen])]
            if not len(chosen):
                break
            top[chosen] = k
        far = np.where(top >= 0, np.left_shift(1, np.maximum(top, 0)), 0)
        chosen = np.flatnonzero(top > 0)
        for k in range(int(top.max(initial=0)) - 1, -1, -1):
            some = chosen[top[chosen] > k]
            more = some[equal(k, some, far[some])]
            far[more] += 1 << k
        return far

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words from places i < j of one row on."""

        def equal(k: int, c: np.ndarray, far: np.ndarray) -> np.ndarray:
            level = self.levels[k]
            return level[i[c] + far] == level[np.minimum(j[c] + far, self.n)]

        return self._reach(equal, len(i))

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words before places i < j of one row (j may be the row's end)."""
        room = i - self.start[np.minimum(j - 1, self.n - 1)]

        def equal(k: int, c: np.ndarray, far: np.ndarray) -> np.ndarray:
            back = far + (1 << k)
            inside = back <= room[c]
            level = self.levels[k]
            return inside & (level[np.where(inside, i[c] - back, 0)] == level[np.where(inside, j[c] - back, 0)])

        return self._reach(equal, len(i))

    def previous_factors(self) -> tuple[list[int], list[int]]:
        """For each place the length of the longest stretch from it that also starts earlier, and where.

        Places are unlinked from the suffix array from the last to the first: the neighbours of a
        place are then the nearest suffixes that start before it.
        """
        n, array = self.n, self.array
        longest, source = [0] * n, [0] * n
        if not n:
            return longest, source
        word = self.levels[0]
        same = np.flatnonzero(word[array[1:]] == word[array[:-1]])  # neighbours with a common prefix
        common = np.zeros(n + 1, np.int64)
        a, b = array[same], array[same + 1]
        common[same + 1] = self.ahead(np.minimum(a, b), np.maximum(a, b))
        slots = np.union1d(same, same + 1)
        m = len(slots)
        common = np.append(common[slots], 0).tolist()  # by number among the slots that matter
        places = array[slots]
        before, after = list(range(-1, m)), list(range(1, m + 2))
        order = np.argsort(-places).tolist()
        at = places.tolist()
        at.append(0)
        for r in order:
            p, q = before[r], after[r]
            left, right = common[r], common[q]
            i = at[r]
            if left >= right:
                longest[i], source[i] = left, at[p]
                common[q] = right
            else:
                longest[i], source[i] = right, at[q]
                common[q] = left
            after[p] = q  # p = -1 writes behind the end, which no one reads
            before[q] = p
        return longest, source


def found_runs(words: np.ndarray, begin: np.ndarray, least: int = 6, times: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end and smallest period of every run, by start, end and period.

    A run is a stretch with period q, `times` (at least 2) * q and `least` words long at least,
    that no neighbouring word of its row extends.
    """
    none = np.zeros(0, np.int64)
    if times < 2:
        raise ValueError("times must be 2 or more")
    if not len(words):
        return none, none, none
    s = Suffixes(words, begin)
    longest, source = s.previous_factors()
    edges, i = [], 0
    while i < s.n:
        edges.append(i)
        i += longest[i] or 1
    edges = np.asarray(edges)
    edge = np.append(edges, s.n)
    size = np.diff(edge)  # of the block from each edge
    row_start = begin[:-1][np.diff(begin) > 0]
    opens = np.isin(edges, row_start)  # a row's first block: nothing lies before it
    # Each edge of a row, its end included: words of the block before and of the block after it.
    inner = np.flatnonzero(~opens)
    closing = np.flatnonzero(np.append(opens[1:], True))
    where = np.concatenate([edges[inner], edge[closing + 1]])
    before = np.concatenate([size[inner - 1], size[closing]])
    after = np.concatenate([size[inner], np.zeros(len(closing), np.int64)])
    stop = begin[s.row[where - 1] + 1]
    # A run over the edge that also holds the edge before reaches less than its period beyond that one.
    most = (before + after) // (times - 1)
    at = np.repeat(np.arange(len(where)), most)
    period = np.arange(len(at)) - np.repeat(np.cumsum(most) - most, most) + 1
    edge_at, ends = where[at], stop[at]
    parts = []
    right = edge_at + period < ends
    left = edge_at - period >= s.start[edge_at - 1]
    for low, high, p in ((edge_at[right], (edge_at + period)[right], period[right]), ((edge_at - period)[left], edge_at[left], period[left])):
        limit = begin[s.row[high - 1] + 1]
        inside = high < limit
        far = np.zeros(len(low), np.int64)
        far[inside] = s.ahead(low[inside], high[inside])
        back = s.behind(low, high)
        good = far + back + p >= np.maximum(least, times * p)
        parts.append(np.stack([(low - back)[good], (high + far)[good], p[good]], 1))
    touching = np.concatenate(parts)
    touching = touching[np.lexsort(touching.T[::-1])]
    if len(touching):
        fresh = np.ones(len(touching), bool)
        fresh[1:] = (touching[1:, :2] != touching[:-1, :2]).any(1)
        touching = touching[fresh]
        holding = np.unique(s.row[touching[:, 0]])
        deep = np.flatnonzero((size >= least + 2) & np.isin(s.row[edges], holding))
        touching = _copied(touching, edges[deep].tolist(), size[deep].tolist(), source)
    return touching[:, 0], touching[:, 1], touching[:, 2]


def _copied(touching: np.ndarray, edges: list[int], sizes: list[int], source: list[int]) -> np.ndarray:
    """Adds the runs inside of blocks: those inside the stretch that a block repeats, moved along."""
    runs = [*map(tuple, touching.tolist())]
    known = set(runs)
    for edge, size in zip(edges, sizes, strict=True):
        origin = source[edge]
        k = bisect.bisect_left(runs, (origin + 1,))
        while k < len(runs) and runs[k][0] < origin + size:
            start, end, period = runs[k]
            moved = (start + edge - origin, end + edge - origin, period)
            if end < origin + size and moved not in known:
                known.add(moved)
                bisect.insort(runs, moved)  # behind k: a block that overlaps its origin meets it again
            k += 1
    return np.asarray(runs, np.int64).reshape(-1, 3)


def repeats(docs: DataFrame, text: str = "text", keep: Iterable[str] | None = None, least: int = 6, times: int = 4) -> DataFrame:
    """`docs` with `runs` and `collapsed`, which replace columns of those names.

    `runs` lists start (number of the first word, from 0), length and period, by start and then
    period. `collapsed` is the text without the words that a run holds behind its first period,
    joined by one space. `keep` names the columns that stay (default: all).

    Null and empty texts, and texts of white space, have no runs and an empty `collapsed`. A text is
    worked on whole, in one task; about a hundred bytes of memory go with each word of the
    longest one. Repeated rows are rows of their own; an empty table stays empty.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("runs", "collapsed")]
    kept = [f"c{i}" for i in range(len(names))]  # plain names inside, whatever the columns are called
    fields = [T.StructField(k, docs.schema[c].dataType) for k, c in zip(kept, names, strict=True)]
    schema = T.StructType([*fields, T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])
    columns = [F.col(f"`{c}`").alias(k) for k, c in zip(kept, names, strict=True)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", 1 << 21):
            words, begin, dictionary = tokens(batch.column("__text"))
            start, end, period = found_runs(words, begin, least, times)
            # Words at or behind a run's start + period, up to its end, go.
            turn = np.bincount(start + period, minlength=len(words) + 1) - np.bincount(end, minlength=len(words) + 1)
            stay = np.cumsum(turn)[: len(words)] == 0
            left = np.concatenate([[0], np.cumsum(stay)])[begin].astype(np.int32)
            letters = dictionary.cast(pa.binary()).take(pa.array(words[stay]))
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(left), letters), b" ").cast(pa.string())
            at = np.searchsorted(start, begin).astype(np.int32)
            row = np.searchsorted(begin, start, "right") - 1
            listed = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start - begin[row], end - start, period)], fields=list(_RUN))
            order = np.lexsort((period, start))
            runs = pa.ListArray.from_arrays(pa.array(at), listed.take(pa.array(order)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), runs, joined], [*kept, "runs", "collapsed"])

    return docs.select(*columns, F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(rows, schema).toDF(*names, "runs", "collapsed")
