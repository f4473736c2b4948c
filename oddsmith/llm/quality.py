"""Quality by importance resampling.

Generative models over hashed n-grams, of the documents labelled good and of all documents, give
every document a log importance weight. The n-grams are words, pairs of words and the one to three
bytes that words are made of; one more model asks whether a word repeats the one before it. Gumbel
noise makes the k largest noisy weights a sample without replacement in proportion to the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsmith.llm.common import dropped, slices, text_key, uniform, written
from oddsmith.llm.textvec import mix, raw, words

BYTES = (1, 2, 3)  # lengths of the n-grams of bytes
MODELS = len(BYTES) + 3  # and words, pairs of words, repeats
BUCKETS = 1 << 14  # of each model
_PRIOR = 1e-3  # share of all documents' distribution in the target model
TEMPERATURE = 4.0  # sharpness of the sample: log weights are divided by it before the noise of about 1 comes on
_RADIX = 16  # bits that one pass of the selection settles
_STEP = 1 << 20  # bytes whose n-grams are held at once


def grams(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row and bucket of every n-gram that lies within one row, model by model and piece by piece."""
    data, offsets = raw(texts)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    for lo in range(0, len(data), _STEP):
        piece, of = data[lo : lo + _STEP + max(BYTES) - 1], row[lo : lo + _STEP + max(BYTES) - 1]
        value = np.zeros(len(piece), np.uint64)
        for k in range(max(BYTES)):
            if len(piece) <= k:
                break
            value = value[: len(piece) - k] * np.uint64(256) + piece[k:]
            if k + 1 in BYTES:
                inside = (of[: len(value)] == of[k : k + len(value)])[:_STEP]
                bucket = (mix(value[:_STEP][inside] + np.uint64(k + 1 << 32)) % np.uint64(BUCKETS)).astype(np.int64)
                yield of[: len(inside)][inside], bucket + BYTES.index(k + 1) * BUCKETS
    w = words(texts)
    for lo in range(0, len(w.hashes), _STEP):
        hashes, of = w.hashes[max(lo - 1, 0) : lo + _STEP], w.row[max(lo - 1, 0) : lo + _STEP]
        new = slice(1 if lo else 0, None)
        yield of[new], (hashes[new] % np.uint64(BUCKETS)).astype(np.int64) + len(BYTES) * BUCKETS
        pair = of[1:] == of[:-1]
        both = mix(mix(hashes[:-1]) * np.uint64(3) + hashes[1:])[pair]
        yield of[1:][pair], (both % np.uint64(BUCKETS)).astype(np.int64) + (len(BYTES) + 1) * BUCKETS
        yield of[1:][pair], (hashes[1:] == hashes[:-1])[pair] + (len(BYTES) + 2) * BUCKETS


def model(docs: DataFrame, good: DataFrame) -> np.ndarray:
    """log P(n-gram | good) - log P(n-gram | any document), one number a bucket.

    `good` (doc_id) is a bounded sample of labelled documents; the other model counts all of `docs`.
    """
    marked = docs.select("doc_id", "text").join(F.broadcast(good.select("doc_id", F.lit(1).alias("__good"))), "doc_id", "left")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, target = (np.zeros(MODELS * BUCKETS, np.int64) for _ in range(2))
        for batch in slices(batches, "text"):
            is_good = batch.column("good").to_numpy(zero_copy_only=False).astype(bool)
            for row, bucket in grams(batch.column("text")):
                every += np.bincount(bucket, minlength=len(every))
                target += np.bincount(bucket[is_good[row]], minlength=len(every))
        at = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(every[at]), pa.array(target[at])], ["bucket", "n", "g"])

    parts = marked.select(F.col("text").cast("string"), F.col("__good").isNotNull().alias("good"))
    rows = parts.mapInArrow(count, "bucket long, n long, g long").groupBy("bucket").agg(F.sum("n"), F.sum("g")).collect()
    counts = np.zeros((2, MODELS * BUCKETS))  # at most as many rows as buckets came here
    for bucket, n, g in rows:
        counts[:, bucket] = n, g
    if not counts[1].any():
        return np.zeros(counts.shape[1])
    split = counts.reshape(2, MODELS, BUCKETS)
    every = split[0] / np.maximum(split[0].sum(1, keepdims=True), 1)
    # One pseudo-count for each bucket in use, dealt as all documents are: what a small sample of
    # good documents lacks by chance weighs little.
    pseudo = (split[0] > 0).sum(1, keepdims=True)
    target = (split[1] + pseudo * every) / np.maximum(split[1].sum(1, keepdims=True) + pseudo, 1)
    target = (1 - _PRIOR) * target + _PRIOR * every  # so one n-gram weighs log(_PRIOR) at least
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num(np.log(target) - np.log(every), nan=0.0, posinf=0.0, neginf=0.0).ravel()


def noisy_weights(log_weight: np.ndarray, uniforms: np.ndarray, temperature: float) -> np.ndarray:
    """Log weights with Gumbel noise: the k largest are a sample of k without replacement, by weight ** (1 / temperature)."""
    return log_weight / temperature - np.log(-np.log(uniforms))


def weighed(docs: DataFrame, weights: np.ndarray, seed: int, temperature: float = TEMPERATURE) -> DataFrame:
    """doc_id, key (hash of the text), n_bytes, log_weight (mean over models of the sum over n-grams) and the noisy weight.

    `bits` orders as `noisy` does, as a signed 64-bit number. A null or empty text has the
    weight null and the least `bits`.
    """
    at = docs.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            total = np.zeros(batch.num_rows)
            for row, bucket in grams(batch.column("text")):
                total += np.bincount(row, at.value[bucket], batch.num_rows)
            size = np.diff(raw(batch.column("text"))[1])
            total /= MODELS
            noisy = noisy_weights(total, batch.column("u").to_numpy(), temperature)
            bits = noisy.view(np.int64)
            bits = np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)
            none = size == 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("key"),
                    pa.array(size),
                    pa.array(total, mask=none),
                    pa.array(noisy, mask=none),
                    pa.array(np.where(none, np.iinfo(np.int64).min, bits)),
                ],
                ["doc_id", "key", "n_bytes", "log_weight", "noisy", "bits"],
            )

    rows = docs.select("doc_id", F.col("text").cast("string"), text_key("text").alias("key"))
    rows = rows.select("doc_id", "text", "key", uniform(F.lit(seed), F.lit("gumbel"), F.col("doc_id"), F.hex("key")).alias("u"))
    return rows.mapInArrow(score, "doc_id long, key binary, n_bytes long, log_weight double, noisy double, bits long")


def kth_largest(df: DataFrame, k: int, column: str = "bits") -> int:
    """The k-th largest number of a long column, exactly: each pass settles 16 bits by counts."""
    prefix, left = None, k
    for shift in range(64 - _RADIX, -1, -_RADIX):
        inside = df if prefix is None else df.filter(F.shiftright(column, shift + _RADIX) == prefix)
        head = F.shiftright(column, shift).alias("head")
        for head, n in sorted(((r[0], r[1]) for r in inside.groupBy(head).count().collect()), reverse=True):  # 65,536 rows at most
            if left <= n:
                prefix = head
                break
            left -= n
    return prefix


def cut(pairs: list[tuple[float, int]]) -> float:
    """The log weight that parts good from bad labelled documents best, by balanced accuracy.

    Within the gap of equally good cuts it takes the middle.
    """
    good, bad = (np.sort([w for w, q in pairs if q == v]) for v in (1, 0))
    if not len(good) or not len(bad):
        return -np.inf
    edges = np.unique(np.concatenate([good, bad]))
    places = np.concatenate([[edges[0] - 1], (edges[1:] + edges[:-1]) / 2, [edges[-1] + 1]])
    right = 1 - np.searchsorted(good, places) / len(good) + np.searchsorted(bad, places) / len(bad)
    return float(places[int(right.argmax())])


def resampled(docs: DataFrame, labels: DataFrame, seed: int = 29, most_labels: int = 20_000, temperature: float = TEMPERATURE, share: float | None = None) -> DataFrame:
    """doc_id, key, n_bytes, log_weight, noisy, kept for every row of `docs`; key is a hash of the text.

    The target model is fitted on at most `most_labels` labelled documents (those with the least
    hash of their id), the other one on all documents. k, the size of the sample, is `share` of the
    documents that have a text, or, without it, the number of those whose weight exceeds the cut that
    parts good and bad labelled documents. The sample is drawn without replacement, by the weights to
    the power 1 / `temperature`: the k largest noisy weights are kept, all that tie with the k-th
    included, so documents near the cut are kept by chance, the others almost surely. Null and empty
    texts are never kept. Without good and bad labels all other documents are kept. Equal rows, null ids
    too, share their noise and go the same way; a label stands for all rows of its id, and of
    several labels the worst counts. Other columns are left out; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    known = written(known.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(most_labels), "labels")
    weights = model(docs, known.filter("quality = 1"))
    scored = written(weighed(docs, weights, seed, temperature), "weights")
    if share is not None:
        dropped(known)
        return _sampled(scored, round(share * scored.filter("log_weight is not null").count()))
    pairs = scored.join(F.broadcast(known), "doc_id").filter("log_weight is not null").groupBy("doc_id", "quality").agg(F.min("log_weight"))
    least = cut([(w, q) for _, q, w in pairs.collect()])  # one row a label, `most_labels` at most
    dropped(known)
    return _sampled(scored, scored.filter(F.col("log_weight") >= F.lit(least)).count())


def _sampled(scored: DataFrame, k: int) -> DataFrame:
    if not k:
        return scored.select("doc_id", "key", "n_bytes", "log_weight", "noisy", F.lit(False).alias("kept"))
    bound = kth_largest(scored, k)
    kept = F.col("log_weight").isNotNull() & (F.col("bits") >= F.lit(bound))
    return scored.select("doc_id", "key", "n_bytes", "log_weight", "noisy", kept.alias("kept"))
