"""Bounded-space online packing of token pieces into fixed windows.

Each partition keeps at most `open_windows` windows. A piece goes to the fullest window that
still has room for it (best fit); when none has, the fullest window is emitted and a new one
is opened. Windows that are open at a partition's end are merged with those of neighbouring
partitions, a bounded number at a time.
"""

from __future__ import annotations

import base64
import bisect
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsmith.llm.common import slices, written

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_CHUNK = regex.compile(r"(?<=\S) (?=\S)")
_MEMO = 400_000  # chunks that a worker remembers, a few hundred bytes each


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of a `tokenizers` file and their ids; only those that match as they stand."""
    with open(path, encoding="utf-8") as file:
        found = json.load(file)["added_tokens"]
    if any(t[flag] for t in found for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"added tokens with matching rules of their own in {path}")
    return {t["content"]: t["id"] for t in found}


class ByteTokenizer:
    """Ids of a byte-level BPE as little-endian unsigned 32-bit bytes.

    `path` names a vocabulary of ranks (base64 token and rank a line). A single space between
    two other characters always starts a new pretoken, so text is cut there and the chunks'
    ids are remembered; what is not remembered is encoded by the library. Before all that, text is
    cut at the `added` tokens, the longest first, and each gets its own id.
    """

    def __init__(self, path: str, pattern: str, added: dict[str, int] | None = None):
        import tiktoken

        self.added = {t: np.array([i], "<u4").tobytes() for t, i in (added or {}).items()}
        self.around = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if added else None

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.memo: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        if self.around is None:
            return self._plain(text)
        parts, at = [], 0
        for found in self.around.finditer(text):
            parts += self._plain(text[at : found.start()]), self.added[found[0]]
            at = found.end()
        return b"".join((*parts, self._plain(text[at:])))

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        head, *rest = _cut(text)
        memo = self.memo
        parts = list(map(memo.get, rest))
        for i, found in enumerate(parts):
            if found is None:
                parts[i] = self._new(rest[i])
        return self._encode(head) + b"".join(parts)

    def _new(self, chunk: str) -> bytes:
        if len(self.memo) >= _MEMO:
            self.memo.clear()
        ids = self._encode(" " + chunk)
        if len(chunk) <= 64:
            self.memo[chunk] = ids
        return ids

    def _encode(self, text: str) -> bytes:
        return np.asarray(self.encoding.encode_ordinary(text), "<u4").tobytes()


def _cut(text: str) -> list[str]:
    """Text without the single spaces between two characters that are no white space."""
    parts = text.split(" ")
    if all(p and not (p[0].isspace() or p[-1].isspace()) for p in parts):
        return parts
    return _CHUNK.split(text)


class Windows:
    """The open windows of one partition; `closed` receives (sequence, pieces)."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.next = size, most, 0
        self.open: list[tuple[int, int, list]] = []  # used, sequence, pieces; in order

    def add(self, length: int, piece: object) -> list[tuple[int, list]]:
        if length == self.size:
            self.next += 1
            return [(self.next - 1, [(0, piece)])]
        closed = []
        at = bisect.bisect_left(self.open, (self.size - length + 1,)) - 1  # the fullest with room
        if at >= 0:
            best = self.open.pop(at)
        else:
            if len(self.open) >= self.most:
                closed.append(self.open.pop()[1:])
            best = (0, self.next, [])
            self.next += 1
        best[2].append((best[0], piece))
        if best[0] + length == self.size:
            closed.append(best[1:])
        else:
            bisect.insort(self.open, (best[0] + length, *best[1:]))
        return closed


def packed(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    size: int = 1024,
    end_id: int = 0,
    open_windows: int = 64,
    merge_partitions: int = 32,
    added: dict[str, int] | None = None,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and then `end_id`; a null or empty text is `end_id` alone. Documents
    longer than `size` are cut into whole windows and a rest. Every row of `docs` is packed,
    also those of equal or null doc_id. Where a text holds an `added` token, that is one id; without
    `added` its characters are encoded as any others. An empty table gives no rows.
    """
    schema = _PIECE + ", sequence_id long, offset long, part long, used long, still_open boolean"
    names = [f.strip().split()[0] for f in schema.split(",")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        tokenizer, windows = ByteTokenizer(vocabulary, pattern, added), Windows(size, open_windows)
        end = np.array([end_id], "<u4").tobytes()
        out: list[tuple] = []

        def emit(sequence: int, pieces: list, still_open: bool) -> None:
            used = pieces[-1][0] + pieces[-1][1][2]
            out.extend((*piece, part << 32 | sequence, offset, part, used, still_open) for offset, piece in pieces)

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if n == "still_open" else pa.int64()) for c, n in zip(columns, names, strict=True)], names)

        for some in slices(batches, "text", 1 << 21):
            for doc_id, text in zip(some.column("doc_id").to_pylist(), some.column("text"), strict=True):
                ids = tokenizer.ids(text.as_py() or "") + end
                total = len(ids) // 4
                for start in range(0, total, size):
                    cut = ids[4 * start : 4 * (start + size)]
                    length = len(cut) // 4
                    for sequence, pieces in windows.add(length, (doc_id, start, length, zlib.crc32(cut), total)):
                        emit(sequence, pieces, False)
            if out:
                yield batch()
        for _, sequence, pieces in windows.open:
            emit(sequence, pieces, True)
        if out:
            yield batch()

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        """Open windows of a few partitions, each moved as a whole into the fullest window it fits."""
        group = group.sort_values(["sequence_id", "offset"], kind="stable")
        spans = group.groupby("sequence_id", sort=True)["used"].first().sort_values(ascending=False, kind="stable")
        windows = Windows(size, len(spans))
        done = [c for sequence, used in spans.items() for c in windows.add(int(used), sequence)]
        done += [(number, pieces) for _, number, pieces in windows.open]
        base = 1 << 62 | int(group["part"].iloc[0] // merge_partitions) << 32
        to = {old: (base | number, offset) for number, pieces in done for offset, old in pieces}
        old = group["sequence_id"]
        group["offset"] += old.map(lambda s: to[s][1])
        group["sequence_id"] = old.map(lambda s: to[s][0])
        return group[[*names[:7]]]

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pieces = written(texts.mapInArrow(rows, schema), "pieces")
    final = _PIECE + ", sequence_id long, offset long"
    left = pieces.filter("still_open").groupBy(F.expr(f"part div {merge_partitions}").alias("g")).applyInPandas(merge, final)
    return pieces.filter("not still_open").select(*names[:7]).unionByName(left)
