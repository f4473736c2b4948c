"""Words and shingles of whole Arrow text columns as numpy arrays, without Python strings."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = 1 << 20
_PLACES = 64  # of a word's first bytes, whose marks come from a table
_tables: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _tables or len(_tables["up"]) < n:
        size = max(n, _STEP + 4096)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _tables[name] = np.cumprod(steps, dtype=np.uint64)
    return _tables["up"], _tables["down"]


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows one after another, and the n + 1 row offsets; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64, len(texts) + 1 + texts.offset)[texts.offset :]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


@dataclass
class Words:
    hashes: np.ndarray  # uint64, one per word
    row: np.ndarray  # int64, the row that holds the word
    starts: np.ndarray  # first byte
    ends: np.ndarray  # byte after the last one
    data: np.ndarray
    per_row: np.ndarray  # words of each row


def _byte_marks(position: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return mix(mix(position.astype(np.uint64) * _BASE) + byte.astype(np.uint64) + np.uint64(1))


def _identities(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit number a word: a mixed sum of marks, each a mixed function of a byte and its place.

    Unlike a polynomial's, such sums have no structure that words of repeated parts could meet.
    """
    if "marks" not in _tables:
        _tables["marks"] = _byte_marks(np.repeat(np.arange(_PLACES), 256), np.tile(np.arange(256), _PLACES))
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + _STEP, "right")))
        length = ends[at:stop] - starts[at:stop]
        first = np.cumsum(length) - length
        place = np.arange(int(length.sum())) - np.repeat(first, length)
        byte = text[place + np.repeat(starts[at:stop], length)]
        marks = _tables["marks"][np.minimum(place, _PLACES - 1) * 256 + byte]
        far = np.flatnonzero(place >= _PLACES)
        marks[far] = _byte_marks(place[far], byte[far])
        out[at:stop] = mix(np.add.reduceat(marks, first) ^ length.astype(np.uint64))
        at = stop
    return out


def words(texts: pa.Array, lower: bool = False, exact: bool = False) -> Words:
    """Words are runs of bytes other than space and \\t..\\r; a word never crosses a row's end.

    The hash depends on the word's bytes alone (`lower`: with A-Z as a-z). By default it is a
    polynomial, quick, but with known pairs of words that meet (long ones of two letters in a
    doubling pattern); `exact` takes a hash without such pairs, for counts that must be right.
    """
    data, offsets = raw(texts)
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none.astype(np.uint64), none, none, none, data, np.zeros(len(offsets) - 1, np.int64))
    space = _SPACE[data]
    first = ~space
    last = first.copy()
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    edge = np.unique(offsets[(offsets > 0) & (offsets < n)])
    first[edge] = ~space[edge]
    last[edge - 1] = ~space[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    text = _LOWER[data] if lower else data
    row = np.searchsorted(offsets, starts, "right") - 1
    per_row = np.bincount(row, minlength=len(offsets) - 1)
    if exact:
        return Words(_identities(text, starts, ends), row, starts, ends, data, per_row)
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # pieces of about _STEP bytes that end with a word
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + _STEP, "right")))
        lo, hi = starts[at], ends[stop - 1]
        up, down = _powers(int(hi - lo) + 1)
        value = np.append((text[lo:hi].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], np.uint64(0))
        bounds = np.stack([starts[at:stop] - lo, ends[at:stop] - lo], 1).ravel()
        hashes[at:stop] = np.add.reduceat(value, bounds)[::2] * down[starts[at:stop] - lo]
        at = stop
    hashes = mix(hashes ^ (ends - starts).astype(np.uint64))
    return Words(hashes, row, starts, ends, data, per_row)


def shingles(texts: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of every distinct shingle of `size` words, by row.

    A text of one to size - 1 words has one shingle, all of its words; an empty one has none.
    """
    w = words(texts)
    h, row = w.hashes, w.row
    if not len(h):
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none
    begin = np.concatenate([[0], np.cumsum(w.per_row)])
    room = begin[row + 1] - np.arange(len(h))  # words from here to the row's end
    acc = np.zeros(len(h), np.uint64)
    for k in range(size):
        here = room > k
        shifted = np.where(here, np.roll(h, -k), np.uint64(0))
        acc = np.where(here, acc * np.uint64(0x100000001B3) + shifted, acc)
    whole = (room >= size) | ((np.arange(len(h)) == begin[row]) & (w.per_row[row] < size))
    row, value = row[whole], mix(acc[whole])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return row[at], value[at], np.diff(np.append(at, len(row)))
