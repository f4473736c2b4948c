"""Line runs, near-duplicates, quality, personal data: small cases and brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from oddsmith.llm import bagminhash, components, linedup, pii, quality, textvec

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, ids=None, source="s"):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in zip(ids, texts, strict=True)], DOCS)


# --- words and shingles ---------------------------------------------------------------------


def test_words_equal_python_split():
    texts = ["a bb  ccc\n\td", "", None, "é ß\x0bx", "one", " lead", "trail ", "x" * 5000 + " y"]
    w = textvec.words(pa.array(texts))
    expected = [(i, x) for i, t in enumerate(texts) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    found = [(int(r), bytes(w.data[a:b]).decode()) for r, a, b in zip(w.row, w.starts, w.ends, strict=True)]
    assert found == expected
    names = defaultdict(set)
    for h, (_, word) in zip(w.hashes.tolist(), expected, strict=True):
        names[word].add(h)
    assert all(len(v) == 1 for v in names.values())
    assert len({h for v in names.values() for h in v}) == len(names)


def test_words_do_not_depend_on_place(monkeypatch):
    text = " ".join(f"w{i}" for i in range(3000))
    whole = textvec.words(pa.array([text])).hashes
    monkeypatch.setattr(textvec, "_STEP", 100)
    assert (textvec.words(pa.array(["zz", text])).hashes[1:] == whole).all()


def test_shingles_count_like_python():
    texts = ["a b c d e f", "a a a a a a a", "a b", "", None, "x y z x y z x y z x y z"]
    row, value, count = textvec.shingles(pa.array(texts))
    for i, t in enumerate(texts):
        words = (t or "").split()
        expected = Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else Counter()
        assert sorted(count[row == i].tolist()) == sorted(expected.values())


# --- line runs ------------------------------------------------------------------------------


def brute_lines(rows, least=5):
    """Every window of lines, in document order, by plain loops."""
    unique = sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5(r[1].encode()).digest()))
    lines = {d: [(p, x) for p, x in enumerate(d[1].split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)] for d in unique}
    gone, seen = defaultdict(set), set()
    for m in range(1, least + 1):
        for d in unique:
            for k in range(len(lines[d]) - m + 1):
                run = lines[d][k : k + m]
                if sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for _, x in run) < least:
                    continue
                key = (m, tuple(x for _, x in run))
                if key in seen:
                    gone[d] |= {p for p, _ in run}
                seen.add(key)
    return {d: "\n".join(x for p, x in enumerate(d[1].split("\n")) if p not in gone[d]) for d in unique}


def check_lines(spark, rows):
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_lines string")
    found = linedup.deduplicated(frame).collect()
    expected = brute_lines(rows)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in found) == sorted(
        (i is None, i or 0, (expected[i, t] if t is not None else "")) for i, t in rows
    )


def test_line_runs_small_cases(spark):
    long = "this line has quite enough words"
    check_lines(spark, [
        (1, f"{long}\nshort"), (2, f"{long}\nshort\nnew"), (3, None), (4, ""), (5, "\n\n"), (None, long), (6, f"{long}\n\n{long}"),
        (7, "a b\nc d\ne f"), (8, "x\na b\nc d\ne f\ny"), (9, "a b\nc d"), (10, "a b\n\nc d\ne f"), (2, f"{long}\nshort\nnew"), (2, "other text of the same id here"),
    ])


def test_line_runs_random(spark):
    rng = random.Random(4)
    lines = ["one two", "three", "four five six", "a longer line of seven words here", "x y z w", ""]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(0, 9)))) for i in range(40)]
    check_lines(spark, rows)


def test_longest_copy_is_a_power_of_two_of_the_run(spark):
    body = "\n".join(f"line number {i} of the body" for i in range(9))
    frame = spark.createDataFrame([(1, body), (2, "head\n" + body), (3, "nothing to see")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in linedup.deduplicated(frame).collect()}
    assert (rows[1]["longest_copy"], rows[2]["longest_copy"], rows[3]["longest_copy"]) == (0, 8, 0)
    assert rows[2]["text"] == "head" and rows[2]["n_deleted"] == 9 and rows[1]["text"] == body


def test_line_runs_empty_table(spark):
    assert linedup.deduplicated(spark.createDataFrame([], DOCS)).collect() == []


# --- near-duplicates ------------------------------------------------------------------------


def jaccard(a, b):
    bags = [Counter(tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))) if t.split() else Counter() for t in (a, b)]
    union = sum((bags[0] | bags[1]).values())
    return sum((bags[0] & bags[1]).values()) / union if union else 1.0


def brute_classes(texts):
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if (texts[i] or "") == (texts[j] or "") or jaccard(texts[i] or "", texts[j] or "") >= 0.8:
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return [root(i) for i in range(len(texts))]


def sample_texts(seed=2):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = [" ".join(word() for _ in range(rng.randrange(1, 160))) for _ in range(25)]
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(word() for _ in range(14)) for _ in range(40)]  # alike, but below the bound
    base = [word() for _ in range(140)]
    chain = list(base)
    for k in range(12):  # each is close to the one before, the ends are not
        texts.append(" ".join(chain))
        chain[k * 11] = f"new{k}"
    return texts + ["", None, "", "two words", "two words", "two  words", "a b c d e", "a b c d e f"]


def test_signature_agreement_is_the_weighted_jaccard():
    rng = np.random.default_rng(0)
    left, right = [], []
    for i in range(120):
        left.append(" ".join([f"u{i}"] * int(rng.integers(8, 90)) + [f"v{i}_{k}" for k in range(40)]))
        right.append(" ".join([f"u{i}"] * int(rng.integers(8, 90)) + [f"v{i}_{k}" for k in range(35)]))
    a, b = pa.array(left), pa.array(right)
    (sa, _), (sb, _) = (bagminhash.signatures(x, 5, 120) for x in (a, b))
    true = bagminhash.similarities(a, b, 5)
    assert np.allclose(true, [jaccard(x, y) for x, y in zip(left, right, strict=True)])
    error = (sa == sb).mean(1) - true
    assert abs(error.mean()) < 4 * error.std() / np.sqrt(len(error)) + 0.002
    assert error.std() < 0.06


def test_classes_equal_brute_force(spark):
    texts = sample_texts()
    found = {r["doc_id"]: r for r in bagminhash.classes(docs(spark, texts)).collect()}
    expected = brute_classes(texts)
    assert [found[i]["class_id"] for i in range(len(texts))] == expected
    sizes = Counter(expected)
    assert all(found[i]["n_alike"] == sizes[c] for i, c in enumerate(expected))


def test_classes_nulls_repeats_and_empty(spark):
    rows = docs(spark, ["same text here", "same text here", "same text here", None, "lone"], [3, 3, None, None, 7])
    found = Counter((r["doc_id"], r["class_id"], r["n_alike"]) for r in bagminhash.classes(rows).collect())
    assert found == Counter({(3, 3, 3): 2, (None, 3, 3): 1, (None, None, 1): 1, (7, 7, 1): 1})
    kept = bagminhash.one_of_each(rows).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == [(False, 3), (False, 7), (True, 0)]
    assert bagminhash.classes(spark.createDataFrame([], DOCS)).count() == 0


def test_components(spark):
    edges = [(b"%03d" % i, b"%03d" % (i + 1)) for i in range(40) if i % 10 != 9] + [(b"500", b"%03d" % i) for i in range(501, 540)]
    found = dict(tuple(bytes(x) for x in r) for r in components.components(spark.createDataFrame(edges, "a binary, b binary")).collect())
    assert all(found[b"%03d" % i] == b"%03d" % (i // 10 * 10) for i in range(40))
    assert all(found[b"%03d" % i] == b"500" for i in range(500, 540))


# --- quality --------------------------------------------------------------------------------


def test_junk_is_rejected_and_clean_text_kept(spark):
    rng = random.Random(1)
    parts = "an er the ing on re st nd ou le ti mo ka pu si".split()
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randrange(2, 5)))
    clean = [" ".join(word() for _ in range(rng.randrange(20, 90))) + "." for _ in range(150)]
    shout = [" ".join(word().upper() + "!!" for _ in range(60)) for _ in range(20)]
    again = [" ".join(x for x in [word() for _ in range(6)] for _ in range(12)) for _ in range(20)]
    texts = clean + shout + again + ["", None]
    frame = docs(spark, texts)
    marks = [(i, 1) for i in range(0, 150, 2)] + [(i, 0) for i in range(150, 190, 2)] + [(None, 1), (3, None)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    kept = {r["doc_id"] for r in quality.resampled(frame, labels).filter("kept").collect()}
    assert len(kept & set(range(150))) >= 148
    assert not kept & set(range(150, 192))


def test_quality_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.resampled(docs(spark, ["a b", None, ""]), none).filter("kept").count() == 1
    assert quality.resampled(docs(spark, []), none).count() == 0


def brute_weights(texts, good):
    """log P(n-gram | good) - log P(n-gram | any), summed over each text, by dictionaries over the n-grams' buckets."""
    marked = lambda v: int(textvec.mix(np.array([v], np.uint64))[0]) % quality.BUCKETS
    known = {}

    def word(w):
        if w not in known:
            known[w] = textvec.words(pa.array([w])).hashes[0]
        return known[w]

    def items(text):
        data, found = text.encode(), []
        for k in quality.BYTES:
            found += [(k, marked(int.from_bytes(data[i : i + k], "big") + (k << 32))) for i in range(len(data) - k + 1)]
        split = re.findall(r"[^\x20\x09-\x0D]+", text)
        found += [("word", int(word(w)) % quality.BUCKETS) for w in split]
        for a, b in itertools.pairwise(split):
            with np.errstate(over="ignore"):
                both = textvec.mix(textvec.mix(np.array([word(a)], np.uint64)) * np.uint64(3) + word(b))[0]
            found += [("pair", int(both) % quality.BUCKETS), ("again", a == b)]
        return found

    each = [items(t or "") for t in texts]
    every, target = (defaultdict(Counter) for _ in range(2))
    for i, found in enumerate(each):
        for model, bucket in found:
            every[model][bucket] += 1
            target[model][bucket] += i in good
    size = lambda c: max(1, sum(c.values()))
    smooth = lambda m, b, n: (target[m][b] + len(every[m]) * n / size(every[m])) / (sum(target[m].values()) + len(every[m]))
    share = {m: {b: (n / size(every[m]), smooth(m, b, n)) for b, n in c.items()} for m, c in every.items()}
    weight = {m: {b: np.log((1 - quality._PRIOR) * g + quality._PRIOR * p) - np.log(p) for b, (p, g) in c.items()} for m, c in share.items()}
    return [sum(weight[m][b] for m, b in found) / quality.MODELS for found in each]


def test_weights_cut_and_sample_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(quality, "_STEP", 50)
    rng = random.Random(13)
    words = [f"{a}{b}" for a in ("an", "re", "ti") for b in ("x", "qu", "on", "é")]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 25))) for _ in range(40)] + ["ZZ ZZ ZZ !! " * k for k in range(1, 15)] + ["", None, texts_long := "an re " * 300, texts_long]
    labels = [(i, 1) for i in range(0, 40, 3)] + [(i, 0) for i in range(41, 54, 3)]
    found = {r["doc_id"]: r for r in quality.resampled(docs(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    expected = brute_weights(texts, {i for i, q in labels if q})
    noisy = {}
    for i, text in enumerate(texts):
        if not text:
            assert found[i]["log_weight"] is None and not found[i]["kept"]
            continue
        assert found[i]["log_weight"] == pytest.approx(expected[i], rel=1e-9, abs=1e-9)
        key = hashlib.md5(text.encode()).hexdigest().upper()
        u = (int(hashlib.md5(f"29:gumbel:{i}:{key}".encode()).hexdigest()[:12], 16) + 0.5) / 16**12
        noisy[i] = expected[i] / quality.TEMPERATURE - np.log(-np.log(u))
    places = sorted(set(found[i]["log_weight"] for i, _ in labels))
    places = [places[0] - 1, *((a + b) / 2 for a, b in itertools.pairwise(places)), places[-1] + 1]
    right = lambda c: np.mean([found[i]["log_weight"] >= c for i, q in labels if q]) + np.mean([found[i]["log_weight"] < c for i, q in labels if not q])
    best = max(places, key=right)
    k = sum(found[i]["log_weight"] >= best for i in noisy)
    assert {i for i in noisy if found[i]["kept"]} == set(sorted(noisy, key=noisy.get, reverse=True)[:k])


def test_inclusion_follows_the_weights_over_seeds():
    rng = np.random.default_rng(0)
    weight, k, turns = np.array([0.0, 1.0, 2.0, 6.0, -3.0, 0.0]), 2, 40_000
    for temperature in (1.0, 3.0):
        noisy = quality.noisy_weights(np.tile(weight, turns), rng.random(turns * 6), temperature).reshape(turns, 6)
        found = np.bincount(np.argsort(-noisy, 1)[:, :k].ravel(), minlength=6) / turns
        p = np.exp(weight / temperature)
        first = p / p.sum()
        known = first + sum(first[j] * np.where(np.arange(6) == j, 0, p / (p.sum() - p[j])) for j in range(6))  # drawn first or second
        assert np.abs(found - known).max() < 0.01


def test_a_share_is_sampled_by_weight(spark):
    texts = ["an re on", "ti mo ka", "ZZ QQ !!"]
    frame = docs(spark, [texts[i % 3] for i in range(1500)] + [None, ""])
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 0)], "doc_id long, quality int")
    rows = quality.resampled(frame, labels, share=0.4, temperature=2.0).collect()
    kept = [sum(r["kept"] for r in rows if r["doc_id"] % 3 == g and r["doc_id"] < 1500) for g in range(3)]
    assert sum(kept) == 600 and not any(r["kept"] for r in rows if r["doc_id"] >= 1500)
    weight = np.exp(np.array([next(r["log_weight"] for r in rows if r["doc_id"] == g) for g in range(3)]) / 2)
    low, high = 0.0, 1e9
    for _ in range(200):  # inclusion is 1 - exp(-rate weight); the rate follows from the size of the sample
        rate = (low + high) / 2
        low, high = (rate, high) if 500 * (1 - np.exp(-rate * weight)).sum() < 600 else (low, rate)
    assert np.abs(np.array(kept) - 500 * (1 - np.exp(-rate * weight))).max() < 45 and kept[0] > max(kept[1:])
    assert {r["doc_id"] for r in quality.resampled(frame, labels, share=0.4, temperature=2.0).filter("kept").collect()} == {r["doc_id"] for r in rows if r["kept"]}
    assert {r["doc_id"] for r in quality.resampled(frame, labels, share=0.4, temperature=2.0, seed=30).filter("kept").collect()} != {r["doc_id"] for r in rows if r["kept"]}


def test_quality_repeats_null_ids_and_extra_columns(spark):
    rows = [(1, "an re", "a"), (1, "an re", "b"), (None, "ti mo ka", "c"), (None, "ti mo ka", "d"), (1, "other text", "e"), (2, "junk", "f")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(1, 1, "z"), (2, 0, "z"), (1, 1, "z")], "doc_id long, quality int, text string")
    found = quality.resampled(frame, labels).collect()
    assert len(found) == 6
    by_row = defaultdict(set)
    for r in found:
        by_row[r["doc_id"], bytes(r["key"])].add((r["log_weight"], r["noisy"], r["kept"]))
    assert all(len(v) == 1 for v in by_row.values())


@pytest.mark.parametrize("k", [1, 5, 77, 200])
def test_kth_largest_is_exact(spark, k):
    rng = random.Random(k)
    values = [rng.randrange(-(2**62), 2**62) for _ in range(150)] + [5] * 50
    frame = spark.createDataFrame([(v,) for v in values], "bits long")
    assert quality.kth_largest(frame, k) == sorted(values, reverse=True)[k - 1]


# --- personal data --------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(text):
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub(r"\D", "", m[0])
        total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
        if 14 <= len(digits) <= 19 and total % 10 == 0:
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return sorted(found)


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    pieces = ["a@b.c", "a@b", "@", "@@", "x.y@z.co.uk", "1.2.3.4", "300.1.1.1", "0001.2.3.4.5.6.7.8", "4539 1488 0343 6467", "4539148803436467", "1234567890123456", "+1 (017) 555-7713",
              "+12", "é", " ", "-", ".", "tok", "+", "(", "9", "+44 20 7946 0958", "a@b.c@d.e", "%%", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 9)))
        assert pii.base_spans(text) == brute_spans(text), text
    assert pii.base_spans("1" * 200_000 + "a" * 200_000 + "@") == []


def test_labelled_spans_and_digest(spark):
    texts = ['mail é x@y.org now, api_key = "abc123DEF456ghi789JKL012"', None, "", "ssn: 123-45-6789 or 473696257 alone", "donaudampfschifffahrtsgesellschaft abcdefghijklmnopqrstuvwxyz", "call tel: (212) 555-0100 please"]
    rows = {r["doc_id"]: r for r in pii.labelled(docs(spark, texts)).collect()}
    assert rows[0]["n_email"] == 1 and rows[0]["base_sha256"] == hashlib.sha256(b"email:7:14").hexdigest()
    assert rows[0]["spans"] == f"email:7:14,secret:{texts[0].index('abc')}:{len(texts[0]) - 1}"
    assert rows[1]["spans"] == rows[2]["spans"] == rows[4]["spans"] == ""
    assert rows[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert rows[3]["spans"] == "id:5:16"
    assert rows[5]["spans"].startswith("phone:")
    assert pii.labelled(docs(spark, [])).count() == 0


def test_candidates_take_linear_time_and_keep_apart():
    text = "a@b.cd (212) 555-0100 " * 20_000
    base = pii.base_spans(text)
    found = pii.candidates(text, base)
    assert len(base) == len(found) == 20_000
    taken = sorted([(s, e) for s, _, e in base] + [(s, e) for s, _, e, _ in found])
    assert all(a[1] <= b[0] for a, b in itertools.pairwise(taken))


PLANTED = {
    "phone": ["Tel: ({0}) 555-01{1}", "Telefon: ({0}) 555-01{1}", "téléphone : ({0}) 555-01{1}", "móvil: ({0}) 555-01{1}"],
    "id": ["ssn: {0}-45-67{1}", "Ausweis: {0}-45-67{1}", "passeport : {0}-45-67{1}", "pasaporte: {0}-45-67{1}"],
    "secret": ["api_key = k{0}Qw8ErT1yUi0oPaS{1}", "Kennwort: x{0}Qw8ErT1yUi0oPaS{1}", "mot de passe : v{0}Qw8ErT1yUi0oPaS{1}", "clave: z{0}Qw8ErT1yUi0oPaS{1}"],
}


def test_recall_of_added_spans_by_kind(spark):
    """Planted in four languages among plain words and numbers: at least 0.9 of each kind, nothing else."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["an", "er", "ti", "mo", "sch", "que"]) for _ in range(rng.randrange(1, 5)))
    plain = lambda: " ".join(word() + rng.choice(["", "", "", f" {rng.randrange(1, 100_000)}"]) for _ in range(30))
    texts, truth = [], []
    for kind, forms in PLANTED.items():
        for i in range(40):
            texts.append(f"{plain()} {forms[i % 4].format(rng.randrange(201, 660), rng.randrange(10, 99))} {plain()}")
            truth.append(kind)
    texts += [plain() for _ in range(60)] + ["call +1 (212) 555-7713 now"] * 20
    rows = sorted(pii.labelled(docs(spark, texts)).collect(), key=lambda r: r["doc_id"])
    for kind in PLANTED:
        caught = [f"{kind}:" in r["spans"] for r, k in zip(rows, truth, strict=False) if k == kind]
        assert sum(caught) >= 0.9 * len(caught), kind
    assert all(r["n_spans"] == 0 for r in rows[120:180])
    assert all(r["n_spans"] == r["n_phone"] == 1 for r in rows[180:])


def test_a_lone_vote_counts_as_the_data_say():
    shape, kind = 1 | 8, pii.KINDS.index("phone")
    bare = pii.accepted(pii.trained([(kind, shape, 200, True), (kind, shape, 20, False), (kind, 8, 200, False)]))  # cues never occur
    cued = pii.accepted(pii.trained([(kind, 7 | 8, 200, True), (kind, 7 | 8, 200, False), (kind, 8, 200, False)]))  # they always do
    assert bare[kind, shape] and not bare[kind, 8]
    assert cued[kind, 7 | 8] and not cued[kind, shape]


def test_labelled_repeats_and_extra_columns(spark):
    frame = spark.createDataFrame([(1, "mail a@b.cd", "x", 1)] * 2 + [(None, "a@b.cd " * 3, None, None)], "doc_id long, text string, spans string, bits int")
    found = pii.labelled(frame).collect()
    assert sorted((r["doc_id"] or 0, r["n_email"], r["n_spans"]) for r in found) == [(0, 3, 3), (1, 1, 1), (1, 1, 1)]


def test_reliabilities_find_the_bad_labeller():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.3
    votes = np.column_stack([np.where(rng.random(4000) < p, truth, ~truth) for p in (0.95, 0.9, 0.55)]).astype(float)
    hit, false, prior = pii.reliabilities(votes, np.ones(4000))
    assert hit[0] - false[0] > hit[2] - false[2] + 0.4
    assert abs(prior - 0.3) < 0.08
