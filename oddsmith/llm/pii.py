"""Personal data by weak supervision.

Regexes, a gazetteer of cue words and context labellers vote on every candidate span. Their
reliabilities are estimated by expectation-maximisation over the counts of vote patterns, those of
the fixed base spans included, and the posteriors train a logistic span classifier, which alone
decides what is accepted beside the base spans.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsmith.llm.common import slices, written

# The kinds in the order of the output, and their base patterns.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "id", "secret")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Candidates beside the base spans: shape only, the votes decide.
_LOOSE = {
    "card": re.compile(r"(?<![\w.+-])[0-9]{4}(?:[\x20-][0-9]{4}){3}(?![\w.-])"),
    "phone": re.compile(r"(?<![\w.+-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![\w-])"),
    "id": re.compile(r"(?<![\w.+-])[0-9]{3}-?[0-9]{2}-?[0-9]{4}(?![\w.-])"),
    "secret": re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{20,}+={0,2}"),
}
# Cue words in English, German, French and Spanish.
GAZETTEER = {
    "card": ("card", "visa", "mastercard", "amex", "credit", "karte", "kredit", "carte", "bancaire", "tarjeta", "crédito"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "anruf", "handy", "rufnummer", "appel", "portable", "llamar", "móvil"),
    "id": ("ssn", "social security", "passport", "tax id", "national id", "ausweis", "reisepass", "steuer", "sozialversicherung", "passeport", "sécurité sociale", "identité", "pasaporte", "seguro social", "dni"),
    "secret": ("token", "password", "passwd", "secret", "api_key", "apikey", "api key", "access key", "bearer", "passwort", "kennwort", "geheim", "schlüssel", "mot de passe", "jeton", "clé", "contraseña", "clave", "secreto"),
}
LABELLERS = ("shape", "gazetteer", "context")
FEATURES = ("shape", "gazetteer", "context", "digits", "letters", "long")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the four base kinds, leftmost and non-overlapping by kind."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:  # from each @ outwards: no long run of letters is scanned twice
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        hit = _DOMAIN.match(text, at) if start < at else None
        if hit:
            found.append((start, 0, hit.end()))
            free = hit.end()
        at = text.find("@", max(at + 1, free))
    for hit in _IP.finditer(text) if "." in text else ():
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in hit[0].split(".")):
            found.append((hit.start(), 1, hit.end()))
    for hit in _CARD.finditer(text):
        if hit.end() - hit.start() >= 14:
            digits = hit[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((hit.start(), 2, hit.end()))
    for hit in _PHONE.finditer(text) if "+" in text else ():
        if 10 <= sum(c in "0123456789" for c in hit[0]) <= 15:
            found.append((hit.start(), 3, hit.end()))
    return sorted(found)


def _shape(kind: str, value: str) -> int:
    """The regex labeller: 1 for a well-formed value, 0 for one that can't be of the kind."""
    digits = re.sub(r"[^0-9]", "", value)
    if kind == "card":
        return int(luhn(digits))
    if kind == "phone":
        return int(value[0] == "(" and digits[0] not in "01")
    if kind == "id":
        return int(value.count("-") == 2 and digits[:3] not in ("000", "666") and digits[3:5] != "00")
    return int(len(digits) >= 4 and bool(re.search(r"[A-Za-z]", value)) and len(set(value)) >= 10)


def _bits(text: str, kind: str, start: int, end: int, shape: int) -> int:
    """The votes and other features of one span."""
    value, before = text[start:end], text[max(0, start - 32) : start].lower()
    found = (
        shape,
        any(w in before for w in GAZETTEER[kind]),
        bool(re.search(r"[:=#]\s*[\"']?$", before)),
        sum(c.isdigit() for c in value) >= 8,
        any(c.isalpha() for c in value),
        len(value) >= 32,
    )
    return sum(int(b) << i for i, b in enumerate(found))


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, bits of FEATURES) of what the loose patterns find outside the base spans."""
    found, taken = [], [(s, e) for s, _, e in base]
    for kind, pattern in _LOOSE.items():
        starts, ends = [], []  # what is taken so far, as intervals apart from one another
        for s, e in sorted(taken):
            if ends and s <= ends[-1]:
                ends[-1] = max(ends[-1], e)
            else:
                starts.append(s)
                ends.append(e)
        for hit in pattern.finditer(text):
            start, end = hit.span()
            at = bisect.bisect_right(ends, start)
            if at < len(starts) and starts[at] < end:
                continue
            found.append((start, KINDS.index(kind), end, _bits(text, kind, start, end, _shape(kind, hit[0]))))
            taken.append((start, end))
    return found


def base_votes(text: str, base: list[tuple[int, int, int]]) -> list[int]:
    """kind * 64 + bits of the base spans of kinds that have candidates too: they are sure to be well-formed."""
    return [k * 64 + _bits(text, KINDS[k], s, e, 1) for s, k, e in base if KINDS[k] in _LOOSE]


def reliabilities(votes: np.ndarray, counts: np.ndarray, sure: np.ndarray | None = None, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation of a two-class model with independent labellers.

    Returns P(vote 1 | yes) and P(vote 1 | no) of each labeller and P(yes). It starts from the
    majority, and each step is smoothed as if each labeller had been right 8 times of 10.
    Rows marked `sure` are known to be yes.
    """
    sure = np.zeros(len(votes), bool) if sure is None else sure
    yes = np.where(votes.mean(1) > 0.5, 0.9, 0.1)
    for _ in range(rounds):
        yes = np.where(sure, 1.0, yes)
        a, b = yes * counts, (1 - yes) * counts
        hit, false = (8 + a @ votes) / (10 + a.sum()), (2 + b @ votes) / (10 + b.sum())
        prior = (1 + a.sum()) / (2 + counts.sum())
        like = lambda p: np.exp(votes @ np.log(p) + (1 - votes) @ np.log(1 - p))  # noqa: B023, E731
        good, bad = prior * like(hit), (1 - prior) * like(false)
        yes = good / (good + bad)
    return hit, false, float(prior)


def posterior(votes: np.ndarray, hit: np.ndarray, false: np.ndarray, prior: float) -> np.ndarray:
    like = lambda p: np.exp(votes @ np.log(p) + (1 - votes) @ np.log(1 - p))
    good, bad = prior * like(hit), (1 - prior) * like(false)
    return good / (good + bad)


def trained(counts: list[tuple[int, int, int, bool]]) -> dict[int, np.ndarray]:
    """Weights of the span classifier by kind, from (kind, bits, rows, whether these are base spans).

    A labeller pool that sees a kind only without any cue has no evidence for it, so the prior
    rows below (one perfect and one bare candidate) are always part of the training set. A vote
    that stands alone counts for as much as the estimated reliabilities say.
    """
    models = {}
    for kind in sorted({k for k, *_ in counts} | {KINDS.index(k) for k in _LOOSE}):
        rows = [(b, n, s) for k, b, n, s in counts if k == kind] + [(7, 5, False), (0, 5, False)]
        x = np.array([[b >> i & 1 for i in range(len(FEATURES))] for b, *_ in rows], float)
        n, sure = np.array([c for _, c, _ in rows], float), np.array([s for *_, s in rows])
        votes = x[:, : len(LABELLERS)]
        soft = np.where(sure, 1.0, posterior(votes, *reliabilities(votes, n, sure)))
        x1, w = np.column_stack([x, np.ones(len(x))]), np.zeros(len(FEATURES) + 1)
        scale = n / n.sum()
        for _ in range(2000):
            p = 1 / (1 + np.exp(-x1 @ w))
            w -= 2.0 * (x1.T @ (scale * (p - soft)) + 1e-4 * w)
        models[kind] = w
    return models


def accepted(models: dict[int, np.ndarray]) -> dict[tuple[int, int], bool]:
    """The classifier's answer for every kind and every combination of features."""
    out = {}
    for kind, w in models.items():
        for bits in itertools.product((0, 1), repeat=len(FEATURES)):
            code = sum(b << i for i, b in enumerate(bits))
            out[kind, code] = bool(np.dot(bits, w[:-1]) + w[-1] > 0)
    return out


def found(docs: DataFrame) -> DataFrame:
    """Spans of every row: doc_id, base and extra arrays of (start, kind, end[, features]), votes of base spans."""
    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64())])
    more = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64()), ("bits", pa.int32())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 22):
            base, extra, votes = [], [], []
            for text in batch.column("text"):
                value = text.as_py() or ""
                spans = base_spans(value)
                votes.append(base_votes(value, spans))
                base.append([dict(zip(("start", "kind", "stop"), s, strict=True)) for s in spans])
                extra.append([dict(zip(("start", "kind", "stop", "bits"), s, strict=True)) for s in candidates(value, spans)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, pa.list_(span)), pa.array(extra, pa.list_(more)), pa.array(votes, pa.list_(pa.int32()))], ["doc_id", "base", "extra", "votes"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        rows, "doc_id long, base array<struct<start:bigint,kind:int,stop:bigint>>, extra array<struct<start:bigint,kind:int,stop:bigint,bits:int>>, votes array<int>"
    )


def labelled(docs: DataFrame) -> DataFrame:
    """Personal data of every row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans.

    The counts and the digest are of the base spans; `spans` lists these and the accepted ones, of
    which there are `n_spans`. Other columns are left out.
    A null or empty text has none. Equal rows give equal rows; an empty table gives none.
    """
    spans = written(found(docs), "spans")
    # At most one row for each kind and combination of features: a few hundred.
    mark = lambda s: F.struct((s["kind"] * 64 + s["bits"]).alias("mark"), F.lit(False).alias("sure"))
    marks = F.concat(F.transform("extra", mark), F.transform("votes", lambda v: F.struct(v.alias("mark"), F.lit(True).alias("sure"))))
    patterns = spans.select(F.explode(marks).alias("s")).groupBy("s.mark", "s.sure").count().collect()
    accept = accepted(trained([(mark // 64, mark % 64, n, sure) for mark, sure, n in patterns]))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    yes = F.array(*[F.lit(k * 64 + b) for (k, b), good in sorted(accept.items()) if good] or [F.lit(-1)])
    name = lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))
    extra = F.filter("extra", lambda s: F.array_contains(yes, s["kind"] * 64 + s["bits"]))
    plain = F.transform(extra, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop")))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{BASE[k]}")
    return spans.select(
        "doc_id",
        *[count(k) for k in range(len(BASE))],
        F.sha2(F.array_join(F.transform("base", name), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(F.array_sort(F.concat("base", plain)), name), ",").alias("spans"),
        (F.size("base") + F.size(plain)).cast("long").alias("n_spans"),
    )
