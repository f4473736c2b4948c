"""Shards, product codes and periodic runs: brute force, inverses, odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from oddsmith.llm import periodic, queries, sharding, vectorcode

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=True)], DOCS)


# --- shards ---------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 1000, 4096, 4097])
def test_permutation_is_one_to_one_and_inverts(n):
    for seed in (0, 9):
        found = sharding.permuted(np.arange(n), n, seed)
        assert sorted(found.tolist()) == list(range(n))
        assert sharding.permuted(found, n, seed, back=True).tolist() == list(range(n))
    if n > 100:
        assert sharding.permuted(np.arange(n), n, 1).tolist() != sharding.permuted(np.arange(n), n, 2).tolist()


def test_permutation_of_very_many_numbers():
    n = 2**62 + 12345
    some = np.array([0, 1, n - 1, n // 3, 2**61])
    found = sharding.permuted(some, n, 3)
    assert found.max() < n and len(set(found.tolist())) == len(some)
    assert sharding.permuted(found, n, 3, back=True).tolist() == some.tolist()
    with pytest.raises(ValueError):
        sharding.permuted(np.array([5]), 5)


def test_permutation_moves_neighbours_apart():
    n = 100_000
    found = sharding.permuted(np.arange(n), n)
    assert abs(np.corrcoef(np.arange(n), found)[0, 1]) < 0.02
    assert abs(np.diff(found)).mean() > n / 4


def test_shards_are_even_and_computable(spark):
    rng = random.Random(2)
    texts = [rng.choice(["same", None, "", "w" * 5000, str(rng.random())]) for _ in range(301)]
    ids = [None if i % 50 == 0 else 7 if i % 3 == 0 else i for i in range(301)]
    frame = docs(spark, texts, ids)
    out = sharding.sharded(frame, 7, seed=4).collect()
    sizes = Counter(r["shard"] for r in out)
    assert len(out) == 301 and set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
        assert sharding.place(r["row_number"], 301, 7, 4) == (r["shard"], r["slot"])
        assert sharding.row_number(r["shard"], r["slot"], 301, 7, 4) == r["row_number"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    order = [(r["doc_id"] is not None, r["doc_id"] or 0, hashlib.md5((r["text"] or "").encode()).digest()) for r in sorted(out, key=lambda r: r["row_number"])]
    assert order == sorted(order)
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter(zip(ids, texts, strict=True))
    again = sharding.sharded(frame.repartition(11), 7, seed=4).collect()
    key = lambda r: (str(r["doc_id"]), str(r["text"]), r["shard"], r["slot"])
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_shards_of_odd_tables(spark, tmp_path):
    clash = spark.createDataFrame([(1, "a", "x", 5, 6, 7), (2, "b", "y", 5, 6, 7)], "doc_id long, text string, number string, place long, shard int, part long")
    out = sharding.sharded(clash, 3)
    assert sorted(out.columns) == sorted(["doc_id", "text", "number", "place", "part", "shard", "slot", "row_number"])
    assert {(r["doc_id"], r["number"], r["place"], r["part"]) for r in out.collect()} == {(1, "x", 5, 7), (2, "y", 5, 7)}
    assert sharding.sharded(docs(spark, ["a"]).limit(0), 3).count() == 0
    assert [r["slot"] for r in sharding.sharded(docs(spark, ["a"]), 3).collect()] == [0]
    with pytest.raises(ValueError):
        sharding.sharded(docs(spark, ["a"]), 0)
    sharding.write_shards(sharding.sharded(docs(spark, [str(i) for i in range(20)]), 3), str(tmp_path / "out"))
    for shard in range(3):
        read = spark.read.parquet(str(tmp_path / "out" / f"shard={shard}")).collect()
        assert [r["slot"] for r in read] == list(range(len(read))) and len(read) in (6, 7)


def test_shards_query(spark, tmp_path):
    texts = ["é" * 3, None, "", "copy", "copy", "z" * 9000]
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    out = {r["doc_id"]: r for r in queries.op11_feistel_shards(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        assert (out[i]["size"], out[i]["text_crc32"], out[i]["law"], out[i]["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
    assert {(r["shard"], r["slot"]) for r in out.values()} == {(p, 0) for p in range(6)}


# --- product codes --------------------------------------------------------------------------


def slow_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """The contract by plain Python integers."""
    kept = [(i, v, label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    whole = [[math.floor(Fraction(x) * scale) for x in v] for _, v, _ in kept]
    step = len(whole[0]) // parts
    cut = [[tuple(w[p * step : (p + 1) * step]) for p in range(parts)] for w in whole]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]
    away = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    for turn in range(rounds + 1):
        codes = [[min(range(len(books[p])), key=lambda e: (away(c[p], books[p][e]), e)) for p in range(parts)] for c in cut]
        if turn < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    if mine := [c[p] for c, code in zip(cut, codes, strict=True) if code[p] == e]:
                        books[p][e] = tuple(sum(xs) // len(mine) for xs in zip(*mine, strict=True))
    errors = [sum(away(c[p], books[p][code[p]]) for p in range(parts)) for c, code in zip(cut, codes, strict=True)]
    return [(i, bytes(code).hex(), error, label) for (i, _, label), code, error in zip(kept, codes, errors, strict=True)], books


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")


def test_codes_equal_plain_integers(spark, tmp_path):
    rng = np.random.default_rng(3)
    points = rng.integers(-3, 4, size=(5, 16)) / 4  # few points: ties and equal entries
    rows = [(i, (points[rng.integers(5)] if i % 3 else rng.normal(size=16).astype(np.float32)).tolist(), None if i % 7 == 0 else i % 4) for i in range(300)]
    rows += [(17, rows[20][1], 1), (None, rows[3][1], 2), (900, None, 1), (901, [], 1), (902, [None] + [1.0] * 15, 1), (903, [float("nan")] * 16, 1), (904, [float("inf")] + [0.0] * 15, 1)]
    vectors(spark, rows).repartition(5).write.parquet(str(tmp_path / "embeddings.parquet"))
    found = queries.op12_product_codes(spark, str(tmp_path)).collect()
    known, books = slow_codes(rows)
    assert Counter((r["vec_id"], r["code"], r["error"]) for r in found) == Counter((i, c, e) for i, c, e, _ in known)
    sums = Counter()
    for _, _, error, label in known:
        sums[label] += error
    labels = {(i, c, e): label for i, c, e, label in known}
    assert all(r["label_error"] == sums[labels[r["vec_id"], r["code"], r["error"]]] for r in found)
    text = ",".join(str(x) for part in books for entry in part for x in entry)
    assert {r["codebooks_sha256"] for r in found} == {hashlib.sha256(text.encode()).hexdigest()}


@pytest.mark.parametrize("size", [1e-3, 3e4, 1e6, 1e17, 1e300])
def test_codes_of_large_and_small_numbers(spark, size):
    rng = np.random.default_rng(int(math.log10(size)) + 50)
    rows = [(i, (rng.normal(size=8) * (size if i % 5 else 1.0)).tolist(), 0) for i in range(60)]
    if size == 1e300:
        rows.append((70, [1.7e308] * 8, 0))
    frame = vectors(spark, rows, "double")
    books = vectorcode.fitted(frame, rounds=3)
    known, slow = slow_codes(rows, rounds=3)
    assert [[tuple(e) for e in part] for part in books.entries] == slow
    found = {r["vec_id"]: (bytes(r["code"]).hex(), r["error"]) for r in vectorcode.encoded(frame, books).collect()}
    assert found == {i: (c, e if e < 2**63 else None) for i, c, e, _ in known}


def test_screening_leaves_near_ties_to_integers():
    rng = np.random.default_rng(8)
    for d, high in ((8, 1 << 20), (1, 1 << 27), (64, 1 << 10), (16, 3)):
        book = rng.integers(-high, high, size=(16, d))
        book[5], book[9] = book[2], book[2] + (np.arange(d) == 0)
        x = np.concatenate([rng.integers(-high, high, size=(2000, d)), (book[rng.integers(0, 16, 500)] + book[rng.integers(0, 16, 500)]) // 2])
        slow = ((x[:, None, :] - book[None]) ** 2).sum(2).argmin(1)
        assert (vectorcode.nearest_entries(x, book) == slow).all()


def test_codes_of_odd_tables(spark):
    few = vectors(spark, [(1, [0.5] * 8, 1), (2, [0.25] * 8, 1), (3, [1.0] * 4, 1), (4, [1.0] * 16, 1)])
    books = vectorcode.fitted(few)
    assert [len(part) for part in books.entries] == [2] * 8 and books.dim == 8
    coded = vectorcode.encoded(few.selectExpr("vec_id", "embedding", "label", "'x' code", "'y' `a.b`"), books)
    assert {(r["vec_id"], bytes(r["code"]).hex(), r["error"], r["a.b"]) for r in coded.collect()} == {(1, "00" * 8, 0, "y"), (2, "01" * 8, 0, "y")}
    assert coded.select(vectorcode.decoded(coded["code"], books).alias("v"), "vec_id").orderBy("vec_id").first()["v"] == [0.5] * 8
    none = few.limit(0)
    assert vectorcode.fitted(none) is None and vectorcode.encoded(none, None).count() == 0
    with pytest.raises(ValueError):
        vectorcode.fitted(few, entries=300)


def test_sums_of_groups_join_without_a_broadcast(spark):
    rows = spark.createDataFrame([(None if i % 2 else i % 41, i, None if i == 0 else i) for i in range(4000)], "k int, i long, e long")
    one = vectorcode.with_group_sum(rows, "k", "e", "s")
    two = vectorcode.with_group_sum(rows, "k", "e", "s", most=5)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect())) and one.count() == 4000
    assert one.filter("i = 0").first()["s"] is None and one.filter("i = 1").first()["s"] == sum(range(1, 4000, 2))


# --- periodic runs --------------------------------------------------------------------------


def slow_runs(words, least=6, times=4):
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, times * p):
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((s, e, p) for (s, e), p in found.items())


def strange_words(rng, most=200):
    k, out = rng.choice([1, 2, 2, 3, 5]), []
    for _ in range(rng.randint(0, 6)):
        block = [rng.randrange(k) for _ in range(rng.randint(1, 7))]
        if out and rng.random() < 0.3:
            at = rng.randrange(len(out))
            block = out[at : at + rng.randint(1, 30)]
        out += block * rng.choice([1, 1, 2, 4, 5, 6])
    return out[:most]


@pytest.mark.parametrize(("least", "times"), [(6, 4), (2, 2), (4, 3)])
def test_runs_equal_those_of_all_periods(least, times):
    rng = random.Random(least)
    for _ in range(700):
        rows = [strange_words(rng) for _ in range(rng.randint(1, 4))]
        begin = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        found = periodic.found_runs(np.array([x for r in rows for x in r], np.int32), begin, least, times)
        known = sorted((a + b, e + b, p) for r, b in zip(rows, begin[:-1].tolist(), strict=True) for a, e, p in slow_runs(r, least, times))
        assert list(zip(*(x.tolist() for x in found), strict=True)) == known


def test_previous_factors_equal_a_search():
    rng = random.Random(4)
    for _ in range(200):
        w = strange_words(rng, 60)
        if w:
            longest, source = periodic.Suffixes(np.array(w), np.array([0, len(w)])).previous_factors()
            for i in range(len(w)):
                far = [next((k for k in range(len(w) - i) if w[i + k] != w[j + k]), len(w) - i) for j in range(i)]
                assert longest[i] == max(far, default=0)
                assert not longest[i] or far[source[i]] == longest[i]


def slow_query(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = [(s, e - s, p) for s, e, p in slow_runs(words)]
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        digest("".join(f"{s},{length},{p}\n" for s, length, p in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_runs_query_equals_plain_loops(spark, tmp_path):
    rng = random.Random(11)
    texts = [" ".join(f"w{x}" for x in strange_words(rng, 150)) for _ in range(150)]
    texts += [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "  a b\tc\x0bd\n", "é ß " * 40, "x " * 3000, " ".join(str(i % 97) for i in range(2000)), " ".join(map(str, range(3000)))]
    rows = [*enumerate(texts), (None, "b c " * 9), (5, "q"), (5, "q"), *((i, " ".join(f"v{rng.randrange(9)}" for _ in range(rng.randint(1, 80)))) for i in range(1000, 1200))]
    docs(spark, [t for _, t in rows], [i for i, _ in rows]).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op13_lpf_runs(spark, str(tmp_path)).collect()
    assert Counter(map(tuple, found)) == Counter((i, *slow_query(i, t)) for i, t in rows)


def test_repeats_of_odd_tables(spark):
    clash = spark.createDataFrame([("a b " * 6, 1, "x", "y"), (None, 2, "x", "y")], "text string, runs int, `a.b` string, collapsed string")
    out = periodic.repeats(clash).orderBy("text").collect()
    assert [(r["text"], r["a.b"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in out] == [(None, "x", [], ""), ("a b " * 6, "x", [(0, 12, 2)], "a b")]
    assert periodic.repeats(clash.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.found_runs(np.zeros(3, np.int32), np.array([0, 3]), 6, 1)
