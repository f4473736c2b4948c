"""Language-model scores from a log-frequency Bloom filter.

Texts are hashed once, into chunks of numbered tokens. Training counts of words and word pairs are
gathered exactly, by a shuffle of packed counts.
A quantised count q = 1 + floor(log2 count) enters the filter as the q items (n-gram, 1) to
(n-gram, q); a look-up probes levels until one is absent. The filter lies in stretches, one for each
shard of the hash space, with ten bits for each item that the shard really has. Up to a small bound
all stretches are broadcast; a filter that grows with the corpus beyond it stays where its counts
are, and the distinct n-grams of a chunk of texts are sent to their shards and come back with
their levels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsmith.llm.common import slices, written
from oddsmith.llm.textvec import mix, words

END = np.uint64(0x1F83D9ABFB41BD6B)  # stands for the end of a text
_PROBES = 4
_CHUNK = 1 << 23  # bytes of the texts whose n-grams are sent to the shards together
_COLUMNS = ("words", "word_counts", "pairs", "pair_counts")


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every token: the words, ASCII letters in lower case, then one end a row."""
    w = words(texts, lower=True, exact=True)
    n = len(w.per_row)
    ends = np.cumsum(w.per_row + 1) - 1
    hashes = np.empty(len(w.hashes) + n, np.uint64)
    is_end = np.zeros(len(hashes), bool)
    is_end[ends] = True
    hashes[ends], hashes[~is_end] = END, w.hashes
    return np.repeat(np.arange(n), w.per_row + 1), hashes


def pairs(row: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every token the hash of what stands before it (END before the first) and of both."""
    before = np.roll(hashes, 1)
    before[:1] = END
    before[1:][row[1:] != row[:-1]] = END
    return before, mix(mix(before) * np.uint64(3) + hashes)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def _cuts(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's part of the sorted `keys` begins, and the end."""
    if shards == 1:
        return np.array([0, len(keys)])
    return np.searchsorted(keys >> np.uint64(64 - int(np.log2(shards))), np.arange(shards + 1, dtype=np.uint64))


def planes(values: np.ndarray) -> bytes:
    """32-bit numbers with all their lowest bytes first, then the next ones: small numbers compress well."""
    return np.asarray(values, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def encoded(rows: DataFrame) -> DataFrame:
    """Texts in chunks of about `_CHUNK` bytes (a longer text is a chunk), each token as a number.

    chunk, bytes and trained (bytes and tokens of its training texts), doc_id, held_out and n_tokens
    (arrays, a value a text), kinds (hashes of the chunk's distinct tokens, frequent ones first) and
    `of` (places in kinds, as `planes`). A fifth of the texts' size, and they are hashed once.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        held: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]] = []  # without texts, tokens a row, hashes

        def flush() -> pa.RecordBatch:
            ids, held_out, size = (pa.concat_arrays([b.column(c) for b, _, _ in held]) for c in ("doc_id", "held_out", "size"))
            per_row, hashes = (np.concatenate([h[i] for h in held]) for i in (1, 2))
            kinds, of, n = np.unique(hashes, return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            rank = np.empty(len(kinds), np.uint32)
            rank[order] = np.arange(len(kinds))
            train = ~held_out.to_numpy(zero_copy_only=False)
            ends = pa.array([0, len(ids)], pa.int32())
            columns = [
                pa.array([part << 32 | done]),
                pa.array([int(size.to_numpy()[train].sum())]),
                pa.array([int(per_row[train].sum())]),
                *(pa.ListArray.from_arrays(ends, x) for x in (ids, held_out, pa.array(per_row, pa.int64()))),
                pa.array([kinds[order].tobytes()], pa.binary()),
                pa.array([planes(rank[of])], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["chunk", "bytes", "trained", "doc_id", "held_out", "n_tokens", "kinds", "of"])

        size = 0
        for batch in slices(batches, "text"):
            row, hashes = tokens(batch.column("text"))
            length = pc.binary_length(batch.column("text")).cast(pa.int64())
            part_of = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), length], ["doc_id", "held_out", "size"])
            held.append((part_of, np.bincount(row), hashes))
            size += pc.sum(length).as_py() + 16 * len(length)
            if size >= _CHUNK:
                yield flush()
                held, size, done = [], 0, done + 1
        if held:
            yield flush()

    return rows.mapInArrow(gather, "chunk long, bytes long, trained long, doc_id array<long>, held_out array<boolean>, n_tokens array<long>, kinds binary, of binary")


def decoded(chunks: pa.RecordBatch | pa.Table, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of chunk `i`: its distinct hashes in order, each token's place among them and each token's row."""
    kinds, of = np.frombuffer(chunks.column("kinds")[i].as_py(), np.uint64), from_planes(chunks.column("of")[i].as_py())
    order = np.argsort(kinds)
    place = np.empty(len(kinds), np.int64)
    place[order] = np.arange(len(kinds))
    per_row = np.asarray(chunks.column("n_tokens")[i].values)
    return kinds[order], place[of], np.repeat(np.arange(len(per_row)), per_row)


def asked(chunks: DataFrame, shards: int) -> DataFrame:
    """The distinct words and pairs of each chunk with their counts in its training texts, a row a shard.

    A shard has the n-grams whose hash starts with its bits; `shards` is a power of two. An n-gram of
    held-out texts alone has the count 0. Counts are `planes`.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                kinds, of, row = decoded(batch, i)
                train = ~batch.column("held_out")[i].values.to_numpy(zero_copy_only=False)[row]
                both, pair = np.unique(pairs(row, kinds[of])[1], return_inverse=True)
                parts = []
                for keys, at in ((kinds, of), (both, pair)):
                    n = np.bincount(at[train], minlength=len(keys))
                    cuts = _cuts(keys, shards)
                    parts.append([(keys[a:b].tobytes(), planes(n[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
                some = [(s, *a, *b) for s, (a, b) in enumerate(zip(*parts, strict=True)) if a[0] or b[0]]
                data = list(zip(*some, strict=True))
                chunk = pa.array([batch.column("chunk")[i].as_py()] * len(some), pa.int64())
                yield pa.RecordBatch.from_arrays([chunk, pa.array(data[0], pa.int32()), *(pa.array(d, pa.binary()) for d in data[1:])], ["chunk", "shard", *_COLUMNS])

    some = chunks.select("chunk", "held_out", "n_tokens", "kinds", "of")
    return some.mapInArrow(ask, "chunk long, shard int, words binary, word_counts binary, pairs binary, pair_counts binary")


def _added(sent: pa.Table) -> list[np.ndarray]:
    """A shard's words, word counts, pairs and pair counts over all chunks, without what never trained."""
    out = []
    for key, n in (_COLUMNS[:2], _COLUMNS[2:]):
        keys = np.frombuffer(b"".join(sent.column(key).to_pylist()), np.uint64)
        counts = np.concatenate([from_planes(x) for x in sent.column(n).to_pylist()]).astype(np.int64)
        keys, counts = _summed(keys, counts)
        out += [keys[counts > 0], counts[counts > 0]]
    return out


def counted(sent: DataFrame) -> DataFrame:
    """Exact counts from `asked`, a row a shard: shard, words, word_counts, pairs, pair_counts (long arrays)."""

    def add(sent: pa.Table) -> pa.Table:
        arrays = [pa.array([x.view(np.int64)], pa.list_(pa.int64())) for x in _added(sent)]
        return pa.table([sent.column("shard").slice(0, 1), *arrays], ["shard", *_COLUMNS])

    return sent.drop("chunk").groupBy("shard").applyInArrow(add, "shard int, words array<long>, word_counts array<long>, pairs array<long>, pair_counts array<long>")


def level(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log2(counts)).astype(np.int64)


def position(keys: np.ndarray, q: np.ndarray | int, probe: int, size: np.ndarray | int) -> np.ndarray:
    """Bit of the item (key, q) for one hash function, in a stretch of `size` bits (below 2 ** 32)."""
    salt = np.asarray(q, np.uint64) * np.uint64(_PROBES) + np.uint64(probe)
    high = mix(keys ^ mix(np.atleast_1d(salt + np.uint64(1)))) >> np.uint64(32)
    return (high * np.asarray(size, np.uint64)) >> np.uint64(32)


class Filter:
    """Read side: an n-gram's quantised count is the number of levels present one after another.

    `ends` are the stretches' last bytes + 1 in `data`, one for each value of the keys' first `lead` bits.
    """

    def __init__(self, data: np.ndarray, ends: np.ndarray, lead: int):
        self.data, self.lead = data, lead
        self.size = 8 * np.diff(ends, prepend=0).astype(np.uint64)
        self.base = 8 * np.append(0, ends[:-1]).astype(np.uint64)

    def levels(self, keys: np.ndarray, most: int = 48) -> np.ndarray:
        found, at = np.zeros(len(keys), np.int64), np.arange(len(keys))
        shard = (keys >> np.uint64(64 - self.lead)).astype(np.int64) if self.lead else np.zeros(len(keys), np.int64)
        for q in range(1, most + 1):
            for probe in range(_PROBES):
                place = self.base[shard[at]] + position(keys[at], q, probe, self.size[shard[at]])
                byte = self.data[(place >> np.uint64(3)).astype(np.int64)]
                at = at[(byte >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
                if not len(at):
                    return found
            found[at] = q
        return found


def _arrays(batch: pa.RecordBatch, i: int) -> list[np.ndarray]:
    return [np.asarray(batch.column(c)[i].values) for c in _COLUMNS]


def level_sizes(counts: DataFrame) -> dict[int, dict[int, tuple[int, int]]]:
    """For words (1) and pairs (2): the number of n-grams and their tokens on each level."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 64, 2), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                for order, n in enumerate(_arrays(batch, i)[1::2]):
                    if len(n):
                        at = level(n)
                        total[order, :, 0] += np.bincount(at, minlength=64)
                        total[order, :, 1] += np.bincount(at, n, 64).astype(np.int64)
        orders, levels = np.nonzero(total[:, :, 0])
        columns = (orders + 1, levels, *total[orders, levels].T)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["n", "level", "kinds", "tokens"])

    rows = counts.mapInArrow(sizes, "n long, level long, kinds long, tokens long").groupBy("n", "level").agg(F.sum("kinds"), F.sum("tokens")).collect()
    out: dict[int, dict[int, tuple[int, int]]] = {1: {}, 2: {}}
    for n, q, kinds, total in rows:
        out[n][q] = (kinds, total)
    return out


def least_level(sizes: dict[int, tuple[int, int]], most: int) -> int:
    """The least level such that the n-grams from there on are `most` at most."""
    fits, used = 64, 0
    for q in sorted(sizes, reverse=True):
        used += sizes[q][0]
        if used > most:
            return fits
        fits = q
    return 1


def stretch(arrays: list[np.ndarray], item_bits: int) -> np.ndarray:
    """A shard's part of the filter, as bytes: its words and pairs on all their levels, `item_bits` bits an item."""
    both = [(keys.view(np.uint64), level(n)) for keys, n in (arrays[:2], arrays[2:]) if len(keys)]
    items = sum(int(q.sum()) for _, q in both)
    on = np.zeros(max(64, -(-items * item_bits // 8) * 8), bool)
    for keys, q in both:
        for step in range(1, int(q.max()) + 1):
            some = keys[q >= step]
            for probe in range(_PROBES):
                on[position(some, step, probe, len(on)).astype(np.int64)] = True
    return np.packbits(on, bitorder="little")


def built(counts: DataFrame, lead: int, item_bits: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The arguments of `Filter` over all shards; each makes its own stretch."""

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = stretch(_arrays(batch, i), item_bits).tobytes()
                yield pa.RecordBatch.from_arrays([batch.column("shard").slice(i, 1), pa.array([part], pa.binary())], ["shard", "data"])

    none = np.zeros(8, np.uint8).tobytes()
    found = dict(map(tuple, counts.mapInArrow(stretches, "shard int, data binary").toLocalIterator()))  # below the bound of a broadcast
    parts = [found.get(shard, none) for shard in range(1 << lead)]
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts]), lead


def estimate(q: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level; 0 for an absent n-gram."""
    return np.where(q > 0, (3 * 2.0 ** (q - 1) - 1) / 2, 0.0)


def modelled(row: np.ndarray, of: np.ndarray, before: np.ndarray, alone: np.ndarray, together: np.ndarray, divisor: float, strength: float) -> np.ndarray:
    """Score of each row. `of` and `before`: each token's word and the one before it, as places in `alone`."""
    history = alone[before]
    single = ((alone + 1) / divisor)[of]
    return np.bincount(row, np.log10((np.minimum(together, history) + strength * single) / (history + strength)), row[-1] + 1)


def scored_by_shards(chunks: DataFrame, sent: DataFrame, tokens_trained: int, item_bits: int, strength: float) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score and score, for a filter too large for one worker.

    What a chunk asks holds its own counts, so one shuffle serves both: a shard adds the counts up,
    makes its stretch of the filter and sends back each word's exact count and level and each pair's
    level, in the order of the hashes; the answers of all shards side by side belong to the chunk's
    sorted n-grams.
    """

    def answer(sent: pa.Table) -> pa.Table:
        arrays = _added(sent)
        part = stretch(arrays, item_bits)
        bloom = Filter(part, np.array([len(part)]), 0)
        out: dict[str, list[bytes]] = {"counts": [], "levels": [], "pair_levels": []}
        for key, level_name in (("words", "levels"), ("pairs", "pair_levels")):
            parts = sent.column(key).to_pylist()
            kinds, of = np.unique(np.frombuffer(b"".join(parts), np.uint64), return_inverse=True)
            answers = {level_name: bloom.levels(kinds).astype(np.uint8)[of]}
            if key == "words":
                exact = np.zeros(len(kinds), np.int64)
                exact[np.searchsorted(kinds, arrays[0])] = arrays[1]
                answers["counts"] = exact[of]
            start = 0
            for n in (len(x) // 8 for x in parts):
                for name, values in answers.items():
                    out[name].append(values[start : start + n].tobytes())
                start += n
        kinds_here = np.zeros(sent.num_rows, np.int64)
        kinds_here[:1] = len(arrays[0])
        return pa.table({"chunk": sent.column("chunk"), "shard": sent.column("shard"), "kinds_here": pa.array(kinds_here), **{c: pa.array(v, pa.binary()) for c, v in out.items()}})

    answers = sent.groupBy("shard").applyInArrow(answer, "chunk long, shard int, kinds_here long, counts binary, levels binary, pair_levels binary")
    answers = written(answers, "answers")
    divisor = float(tokens_trained + (answers.agg(F.sum("kinds_here")).first()[0] or 0) + 1)

    def score(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("shard")
        count, alone, together = (np.frombuffer(b"".join(answers.column(c).to_pylist()), kind) for c, kind in (("counts", np.int64), ("levels", np.uint8), ("pair_levels", np.uint8)))
        kinds, of, row = decoded(chunk, 0)
        before, pair = pairs(row, kinds[of])
        which = np.unique(pair, return_inverse=True)[1]
        model = modelled(row, of, np.searchsorted(kinds, before), estimate(alone.astype(np.int64)), estimate(together.astype(np.int64))[which], divisor, strength)
        base = np.bincount(row, np.log10((count + 1) / divisor)[of])
        seen = np.bincount(row, (count > 0)[of]).astype(np.int64)
        ids, held_out, n_tokens = (chunk.column(c).combine_chunks().flatten() for c in names[:3])
        return pa.table([ids, held_out, n_tokens, pa.array(seen), pa.array(base), pa.array(model)], names)

    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
    answers = answers.drop("kinds_here")
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def scored(
    docs: DataFrame,
    most_bits: int = 24,
    most_exact: int = 1 << 21,
    strength: float = 100.0,
    shard_bytes: int = 1 << 21,
    item_bits: int = 10,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row.

    Training texts are those whose crc32(doc_id as text) mod 7 is not 2 (a null id trains). The base
    score needs exact counts of words: the `most_exact` most frequent words at most are
    broadcast, the occurrences of all others meet their counts in a join, so no frequent word
    is ever a join key. The model interpolates pair and word counts that it probes in the filter:
    P(w | h) = (c(hw) + strength P(w)) / (c(h) + strength). A filter that may have more than
    2 ** `most_bits` bits is not broadcast but probed shard by shard (`scored_by_shards`), with the
    same results: it has `item_bits` bits for each item, so it grows with the corpus.
    A null or empty text is its end token alone. Repeated rows count, and are scored, each; other
    columns are left out. An empty table gives no rows.
    """
    crc = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (crc % 7 == 2).alias("held_out"))
    chunks = written(encoded(rows), "chunks")
    size, total = (x or 0 for x in chunks.agg(F.sum("bytes"), F.sum("trained")).first())
    lead = max(4, min(20, int(np.ceil(np.log2(max(1, size / shard_bytes))))))
    sent = asked(chunks, 1 << lead)
    fixed = ["doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score"]
    # An n-gram seen c times has 1 + floor(log2 c) <= c items: words and pairs have two a token at most.
    if item_bits * 2 * total > 1 << most_bits:
        return scored_by_shards(chunks, sent, total, item_bits, strength).select(*fixed)
    counts = written(counted(sent), "counts")
    sizes = level_sizes(counts)
    divisor = float(total + sum(n for n, _ in sizes[1].values()) + 1)
    bloom = docs.sparkSession.sparkContext.broadcast(built(counts, lead, item_bits))

    exact_level = least_level(sizes[1], most_exact)
    all_words = counts.select(F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("word_counts").alias("c")))).toDF("word", "c")
    bound = 2 ** min(exact_level - 1, 62)
    head = all_words.filter(F.col("c") >= bound).toArrow()  # most_exact rows at most
    keys, known = head["word"].to_numpy().view(np.uint64), head["c"].to_numpy()
    order = np.argsort(keys)
    table = docs.sparkSession.sparkContext.broadcast((keys[order], known[order]))
    whole = exact_level == 1  # then a word that is not broadcast has never been seen

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloomed, (keys, known) = Filter(*bloom.value), table.value
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            for i in range(batch.num_rows):
                kinds, of, row = decoded(batch, i)
                n = len(batch.column("doc_id")[i].values)
                at = np.minimum(np.searchsorted(keys, kinds), max(len(keys) - 1, 0))
                count = np.where(keys[at] == kinds, known[at], 0) if len(keys) else np.zeros(len(kinds), np.int64)
                sure = (count > 0) | whole
                base = np.bincount(row, np.where(sure, np.log10((count + 1) / divisor), 0.0)[of], n)
                seen = np.bincount(row, (count > 0)[of], n).astype(np.int64)
                # The other words go to the join, each once a row.
                rare = ~sure[of]
                both = np.stack([row[rare], of[rare]])
                both, times = np.unique(both, axis=1, return_counts=True) if both.size else (both, np.zeros(0, np.int64))
                ends = np.searchsorted(both[0], np.arange(n + 1)).astype(np.int32)

                alone = estimate(bloomed.levels(kinds))
                before, pair = pairs(row, kinds[of])
                head_at = np.minimum(np.searchsorted(kinds, before), len(kinds) - 1)
                model = modelled(row, of, head_at, alone, estimate(bloomed.levels(pair)), divisor, strength)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((part << 40) + done + np.arange(n)),
                        batch.column("doc_id")[i].values,
                        batch.column("held_out")[i].values,
                        pa.array(np.bincount(row, minlength=n)),
                        pa.array(seen),
                        pa.array(base),
                        pa.array(model),
                        pa.ListArray.from_arrays(ends, pa.array(kinds[both[1]].view(np.int64))),
                        pa.ListArray.from_arrays(ends, pa.array(times)),
                    ],
                    ["at", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "word", "times"],
                )
                done += n

    out = chunks.drop("bytes", "trained").mapInArrow(score, "at long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, word array<long>, times array<long>")
    if whole:
        return out.select(*fixed)
    out = written(out, "scores")
    rare = out.select("at", F.inline(F.arrays_zip("word", "times")))
    met = rare.join(all_words.filter(F.col("c") < bound), "word", "left")
    more = met.groupBy("at").agg(
        F.sum(F.col("times") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(divisor))).alias("more"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"),
    )
    out = out.drop("word", "times").join(more, "at", "left")
    out = out.withColumn("base_score", F.col("base_score") + F.coalesce("more", F.lit(0.0))).withColumn("n_known", F.col("n_known") + F.coalesce("more_known", F.lit(0)))
    return out.select(*fixed)
