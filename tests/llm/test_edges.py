"""Nulls, repeats, long texts, clashing columns; brute force over a given table and over the whole pipeline."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_operators import brute_classes, brute_lines, brute_weights

import corpus_pipeline
from oddsmith.llm import ann, bagminhash, bloomlm, linedup, mixing, packing, quality
from oddsmith.llm.queries import tokenizer_files

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, ids=None, sources=None):
    n = len(texts)
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in zip(ids or range(n), texts, sources or ["s"] * n, strict=True)], DOCS)


# --- vectors --------------------------------------------------------------------------------


def exact(vectors, k):
    found = {}
    for n, (q, x) in enumerate(vectors):
        if q % 20 == 0:
            scores = []
            for m, (i, y) in enumerate(vectors):
                if n != m:
                    total = 0.0
                    for a, b in zip(x, y, strict=True):
                        total += a * b
                    scores.append((-total, i))
            found[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return found


@pytest.mark.parametrize("size", [1e25, 1e-30, 1e150, 1e-170])
def test_nearest_of_very_large_and_small_vectors(spark, size):
    rng = np.random.default_rng(3)
    vectors = [(i, (rng.normal(size=6) * size * 10.0 ** rng.integers(-2, 3)).tolist()) for i in range(120)]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in vectors], "vec_id long, embedding array<double>, rank string, split int")
    found = collections.defaultdict(list)
    for r in ann.nearest(frame, F.col("vec_id") % 20 == 0, k=7, least_splits=2).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    assert dict(found) == exact(vectors, 7)


# --- line runs ------------------------------------------------------------------------------


def test_rows_that_repeat_count_once(spark):
    frame = spark.createDataFrame([(1, "a b\nc", 7), (2, "x\na b\nc", 7), (2, "x\na b\nc", 7)], "doc_id long, text string, seq int")
    found = linedup.deduplicated(frame).collect()
    assert sorted(r["text"] for r in found) == ["a b\nc", "x\na b\nc", "x\na b\nc"]
    assert all(r["n_deleted"] == 0 and r["seq"] == 7 for r in found)


def test_a_text_of_many_lines(spark):
    body = [f"line number {i} of a long text" for i in range(20_000)]
    frame = spark.createDataFrame([(1, "\n".join(body)), (2, "\n".join(["head", *body, "tail"])), (3, "\n".join(["the same line again and again"] * 5_000))], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in linedup.deduplicated(frame).collect()}
    assert (rows[1]["n_deleted"], rows[2]["n_deleted"], rows[3]["n_deleted"]) == (0, 20_000, 4_999)
    assert rows[2]["text"] == "head\ntail" and rows[2]["longest_copy"] == 16_384


# --- near-duplicates ------------------------------------------------------------------------


def test_classes_of_a_given_table_equal_all_pairs(spark):
    """All pairs of sf0.01 that share a shingle, by dictionaries: the same classes, none lost."""
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    bags = []
    for _, text in rows:
        w = text.split()
        bags.append(collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else collections.Counter())
    where = collections.defaultdict(list)
    for i, bag in enumerate(bags):
        for shingle in bag:
            where[shingle].append(i)
    shared = collections.Counter(p for at in where.values() for p in itertools.combinations(at, 2))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sizes, links = [sum(b.values()) for b in bags], 0
    for i, j in shared:
        both = sum((bags[i] & bags[j]).values())
        if both >= 0.8 * (sizes[i] + sizes[j] - both):
            links += 1
            parent[root(i)] = root(j)
    expected = collections.defaultdict(set)
    for i, (doc_id, _) in enumerate(rows):
        expected[root(i)].add(doc_id)
    found = collections.defaultdict(set)
    for r in bagminhash.classes(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect():
        found[r["class_id"]].add(r["doc_id"])
    assert links > 50
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, expected.values()))


def test_near_copies_of_long_texts_with_clashing_columns(spark):
    rng = random.Random(5)
    long = [f"w{rng.randrange(9000)}" for _ in range(60_000)]
    other = [f"v{rng.randrange(9000)}" for _ in range(60_000)]
    edited = list(long)
    for k in range(0, 60_000, 300):
        edited[k] = "new"
    texts = [" ".join(long), " ".join(edited), " ".join(other), " ".join(long[:30_000] + other[:30_000]), "", None]
    frame = docs(spark, texts).selectExpr("*", "1 as key", "'x' as root", "2 as band", "array(1L) as bands", "'y' as class_id", "3 as __key")
    found = {r["doc_id"]: r["class_id"] for r in bagminhash.classes(frame).collect()}
    assert found == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 4}
    kept = bagminhash.one_of_each(frame.drop("__key"))
    assert kept.columns == frame.drop("__key").columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3, 4]


# --- mixing ---------------------------------------------------------------------------------


def test_rows_of_null_and_repeated_ids_have_draws_of_their_own(spark):
    n = 4000
    frame = docs(spark, [f"t{i % 1000}" for i in range(n)], [None] * (n // 2) + [5] * (n // 2)).selectExpr("*", "1 as rate", "2 as weight")
    found = mixing.mixed(frame)
    assert abs(found.count() - n) < 5 * math.sqrt(n)
    by_id = {r["doc_id"]: r["count"] for r in found.groupBy("doc_id").count().collect()}
    assert all(abs(by_id[i] - n / 2) < 5 * math.sqrt(n / 2) for i in (None, 5))
    copies = collections.Counter(r["text"] for r in found.filter("doc_id = 5").collect())
    assert len(set(copies.values())) > 3  # rows of one id do not go together
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, mixing.mixed(frame.repartition(5)).collect()), key=str)


# --- packing --------------------------------------------------------------------------------


def test_packing_repeats_null_ids_and_long_texts(spark):
    long = "word of a long text " * 20_000
    rows = [(1, "same text", 0), (1, "same text", 0), (None, "lone", 0), (None, None, 0), (2, long, 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, offset int")
    found = packing.packed(frame, *tokenizer_files()).collect()
    whole = collections.Counter((r["doc_id"], r["doc_tokens"]) for r in found if r["start"] == 0)
    assert whole[1, max(t for i, t in whole if i == 1)] == 2 and sum(v for (i, _), v in whole.items() if i is None) == 2
    assert sum(r["length"] for r in found if r["doc_id"] == 2) == next(t for i, t in whole if i == 2) > 80_000
    used = collections.Counter()
    for r in found:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 1024


# --- language model -------------------------------------------------------------------------


def test_scores_equal_a_model_by_dictionaries(spark):
    rng = random.Random(12)
    words = [f"w{int(rng.paretovariate(0.9)) % 300}" for _ in range(4000)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 40))) for _ in range(150)] + ["W1 w1 W1", "", None, "never seen before", "w1 w2", "w1 w2"]
    frame = docs(spark, texts).selectExpr("*", "1 as score", "array(1) as word", "2 as at")
    found = {r["doc_id"]: r for r in bloomlm.scored(frame, item_bits=400).collect()}
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), None] for t in texts]
    train = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 7 != 2]
    one = collections.Counter(w for i in train for w in tokens[i])
    two = collections.Counter(p for i in train for p in zip([None, *tokens[i][:-1]], tokens[i], strict=True))
    middle = lambda c: (3 * 2 ** int(math.log2(c)) - 1) / 2 if c else 0.0
    divisor = sum(one.values()) + len(one) + 1
    for i, some in enumerate(tokens):
        total = 0.0
        for before, w in zip([None, *some[:-1]], some, strict=True):
            history = middle(one[before])
            total += math.log10((min(middle(two[before, w]), history) + 100 * (middle(one[w]) + 1) / divisor) / (history + 100))
        assert found[i]["score"] == pytest.approx(total, rel=1e-9)


def test_scores_of_repeated_rows_and_null_ids(spark):
    frame = docs(spark, ["a b c", "a b c", "a b c", None], [1, 1, None, None])
    found = [tuple(r) for r in bloomlm.scored(frame).collect()]
    assert len(found) == 4 and len({r[5:] for r in found if r[2] == 4}) == 1


# --- pipeline -------------------------------------------------------------------------------

ODD = [
    (1, "A first text of the usual kind, plain and long enough to be kept here.\nshared line of six words here", "en", "a", 3),
    (1, "A first text of the usual kind, plain and long enough to be kept here.\nshared line of six words here", "en", "a", 3),
    (1, "Another text with the very same number as the first one has.", "en", None, None),
    (None, "A text without any number at all, but plain all the same.", None, "b", 1),
    (None, None, None, None, None),
    (2, "", "de", "b", 0),
    (3, "shared line of six words here\n" + "words that go on and on " * 30_000, "fr", "a", 9),
    (4, " \n\t", "es", "", 3),
]


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_odd_tables(spark, tmp_path, stage):
    """Nulls, empty and very long texts, repeated rows, no rows and columns of clashing names."""
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    frame = spark.createDataFrame(ODD, DOCS).selectExpr("*", "1 as key", "'k' as kept", "2 as rate", "'r' as root", "array(1) as pos", "3 as n_deleted", "4 as `offset`", "5 as words", "6 as band")
    name, apply = corpus_pipeline.STAGES[stage]
    out = apply(spark, frame, str(tmp_path))
    rows = out.collect()
    if stage < 4:
        assert out.columns == frame.columns and all(r["band"] == 6 for r in rows)
    if name == "line_dedup":
        assert len(rows) == len(ODD) and [r["text"] for r in rows if r["doc_id"] == 3][0].startswith("words that")
    if name == "near_dedup":
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == [(False, 1), (False, 1), (False, 2), (False, 3), (False, 4), (True, 0)]
    if name == "sequence_packing":
        assert sum(r["start"] == 0 for r in rows) == len(ODD)
    assert apply(spark, frame.limit(0), str(tmp_path)).count() == 0


def test_pipeline_equals_brute_force(spark, tmp_path):
    """run() against plain loops over all five stages."""
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(21)
    parts = "an er the ing on re st nd ou le ti mo ka pu si".split()
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randrange(2, 4)))
    vocabulary = [word() for _ in range(400)]
    line = lambda lo, hi: " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(lo, hi))) + "."
    licence = "all rights reserved by the owner"
    texts = ["\n".join(line(4, 20) for _ in range(rng.randrange(2, 6))) for _ in range(90)]
    texts += [f"{licence}\n{t}" for t in texts[:8]] + [t + " tail" for t in texts[8:16]] + [texts[20]] * 3
    texts += [" ".join(word().upper() + "!!" for _ in range(30)) for _ in range(25)] + ["", None]
    texts += [" ".join(line(300, 500) for _ in range(3))]
    sources = [rng.choice(["web", "web", "web", "book", None]) for _ in texts]
    ids = rng.sample(range(1000), len(texts))
    good = [i for i, t in zip(ids, texts, strict=True) if t and "!!" not in t]
    bad = [i for i, t in zip(ids, texts, strict=True) if t and "!!" in t]
    labels = [(i, 1, 0) for i in good[::2]] + [(i, 0, 0) for i in bad[::2]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs(spark, texts, ids, sources).write.parquet(str(tmp_path / "documents.parquet"))
    found = collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    rows = [(i, t, s) for i, t, s in zip(ids, texts, sources, strict=True)]
    weight = dict(zip(ids, brute_weights(texts, {n for n, i in enumerate(ids) if (i, 1, 0) in set(labels)}), strict=True))
    known = {i: q for i, q, _ in labels}
    at = sorted({weight[i] for i in known})
    places = [at[0] - 1, *((a + b) / 2 for a, b in itertools.pairwise(at)), at[-1] + 1]
    right = lambda c: np.mean([weight[i] >= c for i, q in known.items() if q]) + np.mean([weight[i] < c for i, q in known.items() if not q])
    cut = max(places, key=right)
    noisy = {}
    for i, t, _ in rows:
        if t:
            u = (int(hashlib.md5(f"29:gumbel:{i}:{hashlib.md5(t.encode()).hexdigest().upper()}".encode()).hexdigest()[:12], 16) + 0.5) / 16**12
            noisy[i] = weight[i] / quality.TEMPERATURE - math.log(-math.log(u))
    kept = set(sorted(noisy, key=noisy.get, reverse=True)[: sum(weight[i] >= cut for i in noisy)])
    rows = [r for r in rows if r[0] in kept]
    assert 60 < len(rows) < len(texts) - 20

    shorter = brute_lines([(i, t) for i, t, _ in rows])
    rows = sorted((i, shorter[i, t], s) for i, t, s in rows)
    roots = brute_classes([t for _, t, _ in rows])
    rows = [r for n, r in enumerate(rows) if roots[n] == n]

    sizes = collections.Counter(s for *_, s in rows)
    total = sum(math.sqrt(n) for n in sizes.values())
    pack = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = collections.Counter()
    for i, t, s in rows:
        rate = math.sqrt(sizes[s]) * len(rows) / (total * sizes[s])
        u = (int(hashlib.md5(f"17:count:0:{i}".encode()).hexdigest()[:12], 16) + 0.5) / 16**12
        copies, term, reached = 0, math.exp(-rate), math.exp(-rate)
        while reached < u:
            copies += 1
            term *= rate / copies
            reached += term
        encoded = np.array(pack.encode(t, add_special_tokens=False).ids + [0], "<u4")
        for start in range(0, len(encoded), 1024):
            piece = encoded[start : start + 1024]
            if copies:
                expected[i, start, len(piece), zlib.crc32(piece.tobytes()), len(encoded)] += copies
    assert found == expected


def test_columns_of_any_name_stay(spark):
    names = ["__key", "__u", "__n", "__order", "__source", "__parts", "__cdf", "__id", "__hash", "__gone", "a.b", "c1", "copy", "n_lines"]
    texts = ["one two three four five six\nseven eight nine ten eleven", "one two three four five six\nother words of a line here", "x y", None, "x y"]
    rows = [(i, t, "s", *(f"{n}{i}" for n in names)) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    kept = {i: {n: f"{n}{i}" for n in names} for i in range(len(texts))}
    lines = linedup.deduplicated(frame).collect()
    assert {r["doc_id"]: {n: r[n] for n in names if n != "n_lines"} for r in lines} == {i: {n: v for n, v in k.items() if n != "n_lines"} for i, k in kept.items()}
    assert {r["doc_id"]: r["n_deleted"] for r in lines} == {0: 0, 1: 1, 2: 0, 3: 0, 4: 0}
    assert linedup.deduplicated(frame, whole=False).columns == [*(c for c in frame.columns if c != "n_lines"), "n_lines", "n_deleted"]
    one = {r["doc_id"]: {n: r[n] for n in names} for r in bagminhash.one_of_each(frame).collect()}
    assert one == {i: kept[i] for i in (0, 1, 2, 3)}
    mixed = mixing.mixed(frame, {"s": 1.0})
    assert mixed.columns == [*(c for c in frame.columns if c != "copy"), "copy"]
    assert all({n: r[n] for n in names if n != "copy"} == {n: v for n, v in kept[r["doc_id"]].items() if n != "copy"} for r in mixed.collect())
