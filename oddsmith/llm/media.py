"""Signature sniffing for binary columns.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass over a value;
a validator of the format then confirms the structure and measures the length. The object at
offset 0 gives the true type, which corrects the declared one; objects further in are carved.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsmith.llm.common import slices

UNIT = 192  # bytes of a payload's row: 64 pixels of 3 samples
UNKNOWN = "application/octet-stream"
_PIECE = 1 << 20  # bytes that are inflated at a time

# The formats' own magic bytes.
MAGIC = {
    b"RIFF": "audio/wav",
    b"BM": "image/bmp",
    b"\x89PNG\r\n\x1a\n": "image/png",
    b"GIF87a": "image/gif",
    b"GIF89a": "image/gif",
    b"\xff\xd8\xff": "image/jpeg",
    b"%PDF-": "application/pdf",
    b"PK\x03\x04": "application/zip",
    b"\x1f\x8b\x08": "application/gzip",
}
STORED = ("audio/wav", "image/bmp", "image/png")


class Walk:
    """Places that one validator has passed on its way; where an earlier one of its format failed, it fails too."""

    def __init__(self, dead: set[int]):
        self.dead, self.passed = dead, []

    def new(self, at: int) -> bool:
        self.passed.append(at)
        return at not in self.dead

    def failed(self) -> None:
        self.dead.update(self.passed)


class Value:
    """One value under inspection: end marks are searched once, and no format walks the same way to failure twice."""

    def __init__(self, data: bytes):
        self.data, self.marks, self.dead = data, {}, {}

    def next(self, mark: bytes, at: int) -> int | None:
        """The first place of `mark` at or behind `at`."""
        if mark not in self.marks:
            self.marks[mark] = [m.start() for m in re.finditer(re.escape(mark), self.data)]
        places = self.marks[mark]
        i = bisect.bisect_left(places, at)
        return places[i] if i < len(places) else None

    def walk(self, kind: str) -> Walk:
        return Walk(self.dead.setdefault(kind, set()))


def _wav(v: Value, at: int) -> int | None:
    b = v.data
    if len(b) < at + 44 or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    # A walk to another end passes the same places in vain only if it ends at the same one.
    pos, seen, walk = at + 12, set(), v.walk(f"wav {end}")
    while end <= len(b) and pos + 8 <= end and walk.new(pos):
        seen.add(b[pos : pos + 4])
        size = struct.unpack_from("<I", b, pos + 4)[0]
        pos += 8 + size + size % 2
    return end - at if pos in (end, end + 1) and {b"fmt ", b"data"} <= seen else (walk.failed() if pos not in (end, end + 1) else None)


def _bmp(v: Value, at: int) -> int | None:
    b = v.data
    if len(b) < at + 54:
        return None
    size, zero, start, header, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    row = (width * bits + 31) // 32 * 4
    fits = 54 <= start <= size <= len(b) - at and row * abs(height) <= size - start
    return size if zero == 0 and header in (40, 108, 124) and planes == 1 and width > 0 and fits else None


def _png(v: Value, at: int) -> int | None:
    b, pos, walk = v.data, at + 8, v.walk("png")
    while pos + 12 <= len(b) and walk.new(pos):
        size = struct.unpack_from(">I", b, pos)[0]
        end = pos + 12 + size
        if end > len(b) or zlib.crc32(b[pos + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            break
        if b[pos + 4 : pos + 8] == b"IEND":
            return end - at
        pos = end
    return walk.failed()


def _gif(v: Value, at: int) -> int | None:
    b, walk = v.data, v.walk("gif")
    if len(b) < at + 14:
        return None
    flags = b[at + 10]
    pos = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)
    while pos < len(b) and walk.new(pos):
        if b[pos] == 0x3B:
            return pos + 1 - at
        if b[pos] == 0x21:
            pos += 2
        elif b[pos] == 0x2C and pos + 10 < len(b):
            pos += 11 + (3 << (b[pos + 9] & 7) + 1 if b[pos + 9] & 128 else 0)
        else:
            break
        while pos < len(b) and b[pos]:
            pos += 1 + b[pos]
        pos += 1
    return walk.failed()


def _jpeg(v: Value, at: int) -> int | None:
    b, pos, walk = v.data, at + 2, v.walk("jpeg")
    while pos + 4 <= len(b) and b[pos] == 0xFF and walk.new(pos):
        kind, size = b[pos + 1], struct.unpack_from(">H", b, pos + 2)[0]
        if size < 2 or not 0xC0 <= kind <= 0xFE:
            break
        pos += 2 + size
        if kind == 0xDA:
            end = v.next(b"\xff\xd9", pos)
            return end + 2 - at if end is not None else walk.failed()
    return walk.failed()


def _pdf(v: Value, at: int) -> int | None:
    end, mark = v.next(b"%%EOF", at), v.next(b"startxref", at)
    return end + 5 - at if end is not None and mark is not None and mark < end else None


def _zip(v: Value, at: int) -> int | None:
    b, end = v.data, v.next(b"PK\x05\x06", at)
    if end is None or end + 22 > len(b):
        return None
    size, start, note = struct.unpack_from("<IIH", b, end + 12)
    return end + 22 + note - at if at + start + size == end and end + 22 + note <= len(b) else None


def _gzip(v: Value, at: int) -> int | None:
    """Inflates in pieces, so no more than _PIECE bytes of the contents are held."""
    b = v.data
    if len(b) < at + 18 or b[at + 3] & 0xE0:
        return None
    inflate, pos, rest = zlib.decompressobj(31), at, b""
    try:
        while not inflate.eof:
            if not rest:
                if pos >= len(b):
                    return None
                rest, pos = b[pos : pos + _PIECE], pos + _PIECE
            inflate.decompress(rest, _PIECE)
            rest = inflate.unconsumed_tail
    except zlib.error:
        return None
    return min(pos, len(b)) - len(inflate.unused_data) - at


VALIDATE = {
    "audio/wav": _wav, "image/bmp": _bmp, "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg,
    "application/pdf": _pdf, "application/zip": _zip, "application/gzip": _gzip,
}


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic, kind in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (len(magic), kind))
    found.make_automaton()
    return found


def objects(content: bytes, magics: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(type, offset, length) of the value itself, if it has a known type, and of what it embeds.

    Carved objects do not overlap one another; the object at offset 0 may hold them.
    """
    found, free, value = [], 0, Value(content)
    hits = sorted((end + 1 - size, kind) for end, (size, kind) in magics.iter(content.decode("latin-1")))
    for at, kind in hits:
        if at and at < free:
            continue
        if length := VALIDATE[kind](value, at):
            found.append((kind, at, length))
            free = at + length if at else 0
    return found


def sniffed(df: DataFrame, content: str = "media", declared: str = "declared") -> DataFrame:
    """Adds `true_type`, `corrected` and `carved` (an array of type, offset, length) to `df`.

    A null or empty value and one of no known format have the type application/octet-stream;
    a null declared type counts as wrong. Columns of these names in `df` are replaced.
    """
    keep = [c for c in df.columns if c not in ("true_type", "corrected", "carved")]
    schema = df.select(*keep).schema
    names = [f.name for f in schema]
    out = f"{schema.toDDL()}{', ' if names else ''}true_type string, corrected boolean, carved array<struct<type:string,offset:bigint,length:bigint>>"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        magics = automaton()
        kind = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
        for batch in slices(batches, content, 1 << 22):
            types, wrong, carved = [], [], []
            for value, said in zip(batch.column(content), batch.column(declared).to_pylist(), strict=True):
                found = objects(value.as_py() or b"", magics)
                types.append(found[0][0] if found and not found[0][1] else UNKNOWN)
                wrong.append(types[-1] != said)
                carved.append([{"type": t, "offset": o, "length": n} for t, o, n in found if o])
            columns = [*(batch.column(n) for n in names), pa.array(types), pa.array(wrong), pa.array(carved, kind)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "true_type", "corrected", "carved"])

    return df.select(*keep).mapInArrow(rows, out)


def wrap(payload: bytes, kind: str) -> bytes:
    """The payload as 8-bit samples of a format; its length is a positive multiple of UNIT."""
    n, rows = len(payload), len(payload) // UNIT
    if kind == "audio/wav":
        return b"RIFF" + struct.pack("<I4s4sIHHIIHH4sI", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", n) + payload
    if kind == "image/bmp":
        return b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + n, 0, 54, 40, 64, -rows, 1, 24, 0, n, 0, 0, 0, 0) + payload
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    lines = b"".join(b"\0" + payload[i : i + UNIT] for i in range(0, n, UNIT))
    head = struct.pack(">IIBBBBB", 64, rows, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines, 1)) + chunk(b"IEND", b"")


def unwrap(media: bytes, kind: str) -> bytes:
    """The samples of a value that `wrap` has made, read by its format's own fields."""
    if kind == "audio/wav":
        return media[44 : 44 + struct.unpack_from("<I", media, 40)[0]]
    if kind == "image/bmp":
        start = struct.unpack_from("<I", media, 10)[0]
        width, height = struct.unpack_from("<ii", media, 18)
        return media[start : start + 3 * width * abs(height)]
    pos, parts = 8, []
    while pos < len(media):
        size = struct.unpack_from(">I", media, pos)[0]
        if media[pos + 4 : pos + 8] == b"IDAT":
            parts.append(media[pos + 8 : pos + 8 + size])
        pos += 12 + size
    lines = zlib.decompress(b"".join(parts))
    return b"".join(lines[i + 1 : i + 1 + UNIT] for i in range(0, len(lines), UNIT + 1))


def stored(docs: DataFrame) -> DataFrame:
    """One media value per document: doc_id, n_bytes, declared, media.

    The text (null: empty) as UTF-8, then spaces up to a positive multiple of 192 bytes, as
    WAV, BMP or PNG samples. Format and declared type follow from the text's CRC, so equal
    texts have equal values; two of three declared types are wrong. Repeated rows and rows of
    null id stay as they are; other columns are left out; an empty table gives no rows.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 22):
            sizes, said, media = [], [], []
            for text in batch.column("text"):
                data = (text.as_py() or "").encode()
                payload = data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT))
                mark = zlib.crc32(payload)
                sizes.append(len(data))
                said.append(STORED[mark // 3 % 3])
                media.append(wrap(payload, STORED[mark % 3]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(said), pa.array(media, pa.binary())],
                ["doc_id", "n_bytes", "declared", "media"],
            )

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(rows, "doc_id long, n_bytes long, declared string, media binary")


def features(media: DataFrame) -> DataFrame:
    """Reads the stored bytes back by their sniffed type and digests them, one row per value of `stored`.

    An empty table gives no rows; columns beside those of `stored` and `sniffed` are left out.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", 1 << 22):
            out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            columns = [batch.column(c) for c in ("media", "true_type", "declared", "corrected", "carved")]
            for value, kind, said, wrong, carved in zip(*columns, strict=True):
                data, kind = value.as_py(), kind.as_py()
                payload = unwrap(data, kind)
                inner = ",".join(f"{c['type']}@{c['offset']}+{c['length']}" for c in carved.as_py())
                out["payload_bytes"].append(len(payload))
                out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
                out["tail_crc32"].append(zlib.crc32(payload[-16:]))
                out["media_bytes"].append(len(data))
                out["media_sha256"].append(hashlib.sha256(data).hexdigest())
                out["feature"].append(f"type={kind};declared={said.as_py()};corrected={int(wrong.as_py())};carved={inner}")
            kinds = {"payload_sha256": pa.string(), "media_sha256": pa.string(), "feature": pa.string()}
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items())],
                ["doc_id", "n_bytes", *out],
            )

    return media.mapInArrow(
        rows,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )
