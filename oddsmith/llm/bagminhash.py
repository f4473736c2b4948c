"""Near-duplicates by weighted minwise hashing of word shingles.

A document is the multiset of its word shingles. A Poisson process belongs to every shingle and
every dyadic range of weights ([0, 1), [1, 2), [2, 4), ...), with a rate of the range's length;
a weight that ends inside a range takes the points below it. A point hits one of m components
at random, and the earliest point of each component is the signature: two signatures agree in a
component with the probability of the multisets' Jaccard similarity. Points are only made
up to a time by which all components are almost surely hit; the few documents that miss go on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsmith.llm.common import Scratch, dropped, plainly, slices, text_key, written
from oddsmith.llm.components import components
from oddsmith.llm.textvec import mix, shingles

BANDS, ROWS = 24, 5  # a pair of similarity 0.8 shares no band once in 14,000
_BLOCK = 1024  # texts of a side of a tile
_TOKENS = 1 << 19  # and their tokens, about


def _points(row: np.ndarray, seed: np.ndarray, low: np.ndarray, width: np.ndarray, weight: np.ndarray, until: np.ndarray, m: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, component, time) of the points of all processes up to `until` of their row."""
    time, state = np.zeros(len(row)), seed
    at, part = np.arange(len(row)), (low + width > weight)
    while len(at):
        state = mix(state + np.uint64(0x9E3779B97F4A7C15))
        gap = -np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        time = time + gap / (m * width[at])
        on = time <= until[row[at]]
        at, time, state = at[on], time[on], state[on]
        if not len(at):
            return
        component = ((state & np.uint64(0x7FF)) * np.uint64(m) >> np.uint64(11)).astype(np.int64)  # bits that `gap` leaves
        taken = np.ones(len(at), bool)
        split = part[at]  # the range is cut by the weight: a point's own level decides
        if split.any():
            level = (mix(state[split] ^ np.uint64(0x5C5C5C5C5C5C5C5C)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            taken[split] = low[at[split]] + level * width[at[split]] < weight[at[split]]
        yield row[at[taken]], component[taken], time[taken]


def signatures(texts: pa.Array, size: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Earliest times (rows by m; inf for a text without words) and total weights."""
    row, value, count = shingles(texts, size)
    n = len(texts)
    total = np.bincount(row, count, n)
    found = np.full((n, m), np.inf)
    levels = np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64)  # ranges beyond [0, 1)
    each = levels + 1
    of = np.repeat(np.arange(len(row)), each)
    level = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
    low = np.where(level, 2.0 ** (level - 1), 0.0)
    width = np.where(level, low, 1.0)
    seed, weight = mix(value[of] + level.astype(np.uint64)), count[of].astype(float)
    rows = row[of]
    until = (np.log(m) + 3) / np.maximum(total, 1)
    todo = np.ones(n, bool)
    while len(of):
        here = todo[rows]
        if not here.any():
            break
        for r, c, t in _points(rows[here], seed[here], low[here], width[here], weight[here], until, m):
            np.minimum.at(found.reshape(-1), r * m + c, t)
        todo &= (total > 0) & np.isinf(found).any(1)
        until = until * 2
    return found, total


def signed(texts: DataFrame, size: int, m: int = BANDS * ROWS, rows_of_band: int = ROWS) -> DataFrame:
    """doc_id and key of `texts` with bands (hashes of a few components each; null for a text without words)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found, total = signatures(batch.column("text"), size, m)
            mark = mix(found.view(np.uint64))
            band = np.zeros((batch.num_rows, m // rows_of_band), np.uint64)
            for k in range(rows_of_band):
                band = mix(band * np.uint64(31) + mark[:, k::rows_of_band])
            band = mix(band + np.arange(band.shape[1], dtype=np.uint64)).view(np.int64)
            none = total == 0
            offsets = np.arange(0, band.size + 1, band.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("key"),
                    pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(none, False)), pa.array(band.ravel())),
                ],
                ["doc_id", "key", "bands"],
            )

    return texts.mapInArrow(rows, "doc_id long, key binary, bands array<long>")


def similarities(left: pa.Array, right: pa.Array, size: int) -> np.ndarray:
    """Jaccard similarity of the shingle multisets, pair by pair; 1 for two texts without words."""
    n = len(left)
    rows, keys, counts = zip(*(shingles(t, size) for t in (left, right)), strict=True)
    marks = [mix(k ^ mix(r.astype(np.uint64))) for r, k in zip(rows, keys, strict=True)]
    _, a, b = np.intersect1d(*marks, return_indices=True)
    both = np.bincount(rows[0][a], np.minimum(counts[0][a], counts[1][b]), n)
    total = np.bincount(rows[0], counts[0], n) + np.bincount(rows[1], counts[1], n) - both
    return np.where(total > 0, both / np.maximum(total, 1), 1.0)


def verified(pairs: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """The pairs (a, b) of keys whose texts are similar enough, by their whole multisets."""
    left = texts.select(F.col("key").alias("b"), F.col("text").alias("right"))
    right = texts.select(F.col("key").alias("a"), F.col("text").alias("left"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in slices(batches, "left"):
            for batch in slices([big], "right"):
                good = pa.array(similarities(batch.column("left"), batch.column("right"), size) >= least)
                yield batch.select(["a", "b"]).filter(good)

    return pairs.join(left, "b").join(right, "a").select("a", "b", "left", "right").mapInArrow(rows, "a binary, b binary")


def tokens(texts: DataFrame, size: int) -> DataFrame:
    """key and tokens of `texts`: 64-bit hashes of the shingles, the n-th copy of one apart from the others."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            row, value, count = shingles(batch.column("text"), size)
            nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            marks = mix(np.repeat(value, count) + mix(nth.astype(np.uint64))).view(np.int64)
            ends = np.searchsorted(np.repeat(row, count), np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.ListArray.from_arrays(ends, pa.array(marks))], ["key", "tokens"])

    return texts.select("key", "text").mapInArrow(rows, "key binary, tokens array<long>")


def met(marks: DataFrame, least: float, write: Scratch) -> DataFrame:
    """The keys of `marks` (key, root, tokens) that may have a partner in another component, by prefix filtering.

    Tokens have one order for all texts: those of a single component first, then the rest from the
    rarest on. Two texts of n and m tokens that overlap enough share one of the first n - ceil(least n) + 1
    and m - ceil(least m) + 1. Tokens of a single component take places there, but join nothing. A
    passage that many unlike texts share comes last, so it keeps none of them.
    """
    flat = marks.select("key", F.xxhash64("root").alias("root"), F.explode("tokens").alias("token"))
    ends = lambda rows: rows.groupBy("token").agg(F.count(F.lit(1)).alias("often"), F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1")
    known = write(ends(flat).select("token", "often"), "known")
    places = F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9) + 1
    shared = flat.select("key", "token").join(known, "token").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("often", "token"))).alias("shared"))
    sized = marks.select("key", F.xxhash64("root").alias("root"), F.size("tokens").alias("n"))
    near = shared.join(sized, "key").withColumn("room", (places - (F.col("n") - F.size("shared"))).cast("int")).filter("room > 0")
    near = write(near.select("key", "root", F.explode(F.transform(F.slice("shared", F.lit(1), F.col("room")), lambda s: s["token"])).alias("token")), "near")
    return near.join(ends(near).select("token"), "token", "left_semi").select("key").distinct()


def parities(parts: list[np.ndarray]) -> np.ndarray:
    """A row of bits for each set of tokens, 16 a token: the parity of the tokens at each place.

    Two rows differ in no more bits than the sets differ in tokens.
    """
    weight = np.array([len(p) for p in parts])
    bits = 1 << max(10, int(np.ceil(np.log2(16 * max(1.0, float(np.median(weight)))))))
    place, times = np.unique(np.repeat(np.arange(len(parts)), weight) * bits + (np.concatenate(parts) & (bits - 1)), return_counts=True)
    on = np.zeros(len(parts) * bits, bool)
    on[place[times % 2 == 1]] = True
    return np.packbits(on).view(np.uint64).reshape(len(parts), bits // 64)


def _close(rows: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links of one tile: pairs of different components that overlap enough by all their tokens.

    Parities rule out most pairs; the others are counted exactly, unless links found so far already join them.
    """
    n = len(rows)
    parts = [np.asarray(t, np.int64) for t in rows["tokens"]]
    weight = np.array([len(p) for p in parts])
    bits = parities(parts)
    key, side = rows["key"].to_numpy(), rows["own"].to_numpy()
    label = np.unique(rows["root"].to_numpy(), return_inverse=True)[1]
    crossing = len(set(side)) > 1  # each block has a tile of its own for its inner pairs
    share, found = (1 - least) / (1 + least), []
    for i in range(n):
        other = np.flatnonzero(label != label[i])
        other = other[other > i]
        if crossing:
            other = other[side[other] != side[i]]
        both = weight[other] + weight[i]
        apart = np.bitwise_count(bits[other] ^ bits[i]).sum(1)
        for j in other[(apart <= share * both + 1e-6) & (np.abs(weight[other] - weight[i]) <= share * both + 1e-6)]:
            if label[j] != label[i]:
                shared = len(np.intersect1d(parts[i], parts[j], assume_unique=True))
                if shared >= least * (weight[i] + weight[j] - shared) - 1e-9:
                    label[label == label[j]] = label[i]
                    found.append((max(key[i], key[j]), min(key[i], key[j])))
    return pd.DataFrame(found, columns=["a", "b"])


def classes(docs: DataFrame, least: float = 0.8, size: int = 5) -> DataFrame:
    """doc_id, key, root, class_id, n_alike for every row of `docs`.

    Rows are alike if a chain of links joins them; a link is an equal text or a multiset
    similarity of at least `least`. class_id is the least doc_id of the class (null if all are
    null), n_alike its number of rows, `key` a hash of the row's text, `root` the class's least key. Null counts as empty text,
    and all empty texts are copies of one another; one of white space alone is alike to equal ones
    only. A text of fewer than `size` words is one
    shingle. Repeated rows are copies; repeated ids with unequal texts are separate documents.

    Equal texts are joined first. In every bucket of a band all texts are held against one
    leader. Buckets that still hold several components are compared across these in tiles, so a link
    that doesn't pass through the leader is found too. Texts whose rarest shingles rule out a partner
    (`met`) stay out of the tiles; no bucket is cut off, and no bucket's pairs are listed.
    """
    write = Scratch()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("key", text_key("text"))
    marked = write(signed(texts, size), "signatures")
    ids = write(marked.groupBy("key").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n")), "ids")
    # One signature for each text: equal texts have equal ones.
    kinds = marked.filter("bands is not null").groupBy("key").agg(F.first("bands").alias("bands"))
    bands = write(kinds.select("key", F.explode("bands").alias("band")), "bands")
    full = write(bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    shared = write(bands.join(full, "band").select("band", "key", "n"), "shared")
    dropped(bands)
    # A bucket's leader is the text whose buckets hold most texts altogether: the middle of a
    # group of near copies shares its bands with nearly all of them.
    fame = write(shared.groupBy("key").agg(F.sum("n").alias("fame")), "fame")
    leads = shared.join(fame, "key").groupBy("band").agg(F.max_by("key", F.struct("fame", "key")).alias("lead"))
    stars = shared.join(write(leads, "leads"), "band").filter("key <> lead").select(F.greatest("key", "lead").alias("a"), F.least("key", "lead").alias("b")).distinct()
    stars = write(stars, "stars")
    involved = shared.select("key").distinct()
    # One row of text for each key that shares a bucket: the row of its least id.
    named = involved.join(ids, "key").select("key", "least_id")
    chosen = texts.join(named, (texts["key"] == named["key"]) & texts["doc_id"].eqNullSafe(named["least_id"]), "left_semi")
    pool = write(chosen.select("key", "text"), "texts")
    once = pool if not _repeats(pool) else write(pool.dropDuplicates(["key"]), "texts")
    links = write(verified(stars, once, size, least), "links")
    roots = components(links)
    # Texts of buckets that still hold several components, and may have a partner in another one.
    placed = shared.join(roots.withColumnRenamed("node", "key"), "key", "left").select("band", "key", F.coalesce("root", "key").alias("root"))
    placed = write(placed, "placed")
    several = lambda rows, *more: rows.groupBy("band").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), *more).filter("r0 <> r1")
    apart = write(placed.join(several(placed).select("band"), "band").select("key", "root").distinct(), "apart")
    marks = write(tokens(once.join(apart, "key", "left_semi"), size).join(apart, "key"), "tokens")
    marks = write(marks.join(met(marks, least, write), "key", "left_semi"), "tokens")
    placed = write(placed.join(marks.select("key", F.size("tokens").alias("n")), "key"), "placed")
    # Buckets of the very same texts are one. The largest component of a bucket is its core:
    # within it nothing is left to find, so tiles hold the other texts, or those and the core.
    same = several(placed, F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("same"), F.count(F.lit(1)).alias("texts"))
    rest = write(placed.join(same.groupBy("same", "texts").agg(F.min("band").alias("band")).select("band"), "band"), "rest")
    cores = rest.groupBy("band", "root").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n"))
    cores = cores.groupBy("band").agg(F.max(F.struct("texts", "root", "n")).alias("core"), F.sum("texts").alias("texts"), F.sum("n").alias("n"))
    blocks = lambda texts, n: F.greatest(F.lit(1), F.ceil(texts / _BLOCK), F.ceil(n / _TOKENS)).cast("int")
    of_core, of_rest = blocks(F.col("core.texts"), F.col("core.n")), blocks(F.col("texts") - F.col("core.texts"), F.col("n") - F.col("core.n"))
    cores = write(cores.select("band", F.col("core.root").alias("core"), of_core.alias("core_blocks"), of_rest.alias("rest_blocks")), "cores")
    rest = rest.drop("n").join(cores, "band").join(marks.select("key", "tokens"), "key")
    in_core = F.col("root") == F.col("core")
    own = F.pmod(F.xxhash64("key"), F.when(in_core, F.col("core_blocks")).otherwise(F.col("rest_blocks"))).cast("int")
    # Blocks of the core have negative numbers, -1 and below.
    rest = rest.withColumn("own", F.when(in_core, -1 - own).otherwise(own))
    others = F.sequence(F.lit(0), F.col("rest_blocks") - 1)
    rest = rest.withColumn("other", F.explode(F.when(in_core, others).otherwise(F.concat(others, F.sequence(-F.col("core_blocks"), F.lit(-1))))))
    tiles = rest.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "root", "tokens")
    more = write(tiles.groupBy("band", "i", "j").applyInPandas(lambda rows: _close(rows, least), "a binary, b binary").distinct(), "links")
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    named = ids.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    named = write(named, "named")
    whole = named.groupBy("root").agg(F.min("least_id").alias("class_id"), F.sum("n").alias("n_alike"))
    known = write(named.join(whole, "root").select("key", "root", "class_id", "n_alike"), "classes")
    write.clear(marked, known)
    return marked.select("doc_id", "key").join(known, "key").select("doc_id", "key", "root", "class_id", "n_alike")


def one_of_each(docs: DataFrame, least: float = 0.8, size: int = 5) -> DataFrame:
    """The row of the least doc_id (then text hash; null ids last) of every class, once. Any other columns may be there."""
    docs, names = plainly(docs, ("doc_id", "text"))
    found = written(classes(docs, least, size).select("doc_id", "key", "root"), "alike")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("key").alias("mark"))).alias("first")
    kept = written(found.groupBy("root").agg(first).select("first.id", "first.mark"), "kept")
    marked = docs.withColumn("__key", text_key("text"))
    out = marked.join(kept, marked["doc_id"].cast("long").eqNullSafe(kept["id"]) & (marked["__key"] == kept["mark"]), "left_semi")
    twice = found.groupBy("doc_id", "key").count().filter("count > 1")
    if not twice.isEmpty():  # repeated rows are rare: only they are compared with one another
        twice = written(twice.select(F.col("doc_id").alias("__d"), F.col("key").alias("__k")), "twice")
        same = out["doc_id"].cast("long").eqNullSafe(F.col("__d")) & (out["__key"] == F.col("__k"))
        out = out.join(twice, same, "left_anti").unionByName(out.join(twice, same, "left_semi").dropDuplicates(["doc_id", "__key"]))
    return out.select(*docs.columns).toDF(*names)


def _repeats(pool: DataFrame) -> bool:
    return not pool.groupBy("key").count().filter("count > 1").isEmpty()
