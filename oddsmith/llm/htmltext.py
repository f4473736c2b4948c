"""Main text of HTML pages by a recurrent block labeller.

A page is the sequence of its leaf blocks. Hashed vectors of the tag path and of the words go
through a bidirectional LSTM in numpy, so each block is judged in the context of the whole
page. The network is trained here, on generated layouts whose truth is known, then on a bounded
sample of the pages themselves, with its own labels and with those of blocks that recur from
page to page; it is small enough to be broadcast.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsmith.llm.common import slices
from oddsmith.llm.textvec import words

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|template|iframe|textarea|title)\b[^>]*>.*?(?:</\1\b[^>]*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+)>"
    r"|<[!?/a-zA-Z][^>]*(?:>|\Z)"
    r"|(<?[^<]*)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)

# Elements of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select "
    "summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
# Class, id and role words of the boxes in generated layouts, and of frames around an article.
CUES = (
    "nav navbar navigation menu breadcrumb breadcrumbs masthead topbar banner footer sidebar aside widget ad ads advert adverts advertisement "
    "advertising adsense sponsor sponsored promo promoted promotion cookie cookies consent notice gdpr alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations more comment comments "
    "disqus respond reply replies discussion search pagination pager toolbar skip legal copyright disclaimer complementary contentinfo "
    "form poll survey feedback tracking hidden header"
).split()
FRAMES = "content article story post entry main body text page wrapper container".split()

_PATH, _WORDS, _FACTS = 512, 16, 5
_STEPS = 1024  # blocks of a page whose gates are held at once when it is labelled
INPUTS = _PATH + _WORDS + _FACTS


@dataclass
class Blocks:
    """The leaf blocks of one page: their texts, paths and the share of text inside links.

    A path is a digest of all elements above a block and of their names; `vectors` has the hashed
    vector of each path, its numbers that are not 0 (place and value, as bytes).
    """

    texts: list[str] = field(default_factory=list)
    paths: list[bytes] = field(default_factory=list)
    links: list[float] = field(default_factory=list)
    vectors: dict[bytes, bytes] = field(default_factory=dict)


def blocks(page: str) -> Blocks:
    """Splits a page into leaf blocks in page order; scripts, styles, drawings and comments leave none."""
    # An element on the stack: its name, its marks, and the digest of the path down to it.
    out, stack, parts = Blocks(), [], []
    inside: Counter[str] = Counter()
    total = np.zeros(_PATH, np.int64)  # the signed sum over all elements on the stack

    def flush() -> None:
        if parts:
            text = " ".join("".join(p for p, _ in parts).split())
            if text:
                linked = sum(len(p) for p, link in parts if link)
                path = stack[-1][2] if stack else b""
                out.texts.append(text)
                out.paths.append(path)
                out.links.append(linked / max(1, sum(len(p) for p, _ in parts)))
                if path not in out.vectors:
                    out.vectors[path] = _packed(total)
            parts.clear()

    def leave(at: int) -> None:
        for name, marks, _ in stack[at:]:
            inside[name] -= 1
            for place, sign in marks:
                total[place] -= sign
        del stack[at:]

    def last(name: str) -> int:
        return next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name)

    for hit in _TOKEN.finditer(page):
        _, closing, name, attributes, text = hit.groups()
        if text is not None:
            if text and not inside["svg"]:
                parts.append((html.unescape(text), inside["a"] > 0))
            continue
        if name is None:
            continue
        name = name.lower()
        if name in BLOCK:
            flush()
            if inside["svg"]:  # a drawing that was never closed ends here
                leave(last("svg"))
        elif name == "br":
            parts.append((" ", inside["a"] > 0))
        if closing:
            if inside[name]:
                leave(last(name))
        elif name not in VOID:
            if name in BLOCK:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p" or stack[i][0] in CLOSES.get(name, ()):
                        leave(i)
                        break
                    if stack[i][0] in BLOCK:
                        break
            own, outer = [name], "page " if name in ("html", "body") else ""
            for kind, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
                own += [f"{outer}{kind[0].lower()}={t}" for t in re.split(r"[^a-z0-9]+", "".join(values).lower()) if t]
            if not attributes.rstrip().endswith("/") or name in BLOCK:
                marks = [_mark(token) for token in own]
                for place, sign in marks:
                    total[place] += sign
                above = stack[-1][2] if stack else b""
                stack.append((name, marks, hashlib.blake2b(above + " ".join(own).encode("utf-8", "surrogatepass"), digest_size=16).digest()))
                inside[name] += 1
    flush()
    return out


def _mark(token: str) -> tuple[int, int]:
    """Place and sign of a token in path vectors."""
    mark = zlib.crc32(token.encode())
    return mark % _PATH, 1 if mark >> 16 & 1 else -1


def _packed(total: np.ndarray) -> bytes:
    at = np.flatnonzero(total)
    return at.astype("<i2").tobytes() + np.clip(total[at], -2, 2).astype("<i2").tobytes()


def _path_vector(packed: bytes) -> np.ndarray:
    found = np.zeros(_PATH)
    at, value = np.frombuffer(packed, "<i2").reshape(2, -1)
    found[at] = value
    return found


def rests(pages: list[Blocks]) -> list[np.ndarray]:
    """What the network reads beside the paths: word vectors and facts of each block, page by page."""
    texts = [t for p in pages for t in p.texts]
    w = words(pa.array(texts, pa.string()), lower=True)
    sign = np.where(w.hashes >> np.uint64(32) & np.uint64(1), 1.0, -1.0)
    flat = np.bincount(w.row * _WORDS + (w.hashes % np.uint64(_WORDS)).astype(np.int64), sign, len(texts) * _WORDS)
    x = np.zeros((len(texts), _WORDS + _FACTS))
    x[:, :_WORDS] = flat.reshape(-1, _WORDS) / np.maximum(w.per_row, 1)[:, None]
    x[:, -5] = np.minimum(np.log1p(w.per_row) / 4, 2)
    x[:, -4] = [v for p in pages for v in p.links]
    x[:, -3] = [t[-1] in ".!?" for t in texts]
    x[:, -2] = [any("0" <= c <= "9" for c in t) for t in texts]
    x[:, -1] = 1
    return np.split(x, np.cumsum([len(p.texts) for p in pages])[:-1]) if pages else []


def vectors(pages: list[Blocks]) -> list[np.ndarray]:
    """A matrix (blocks by INPUTS) for each page."""
    paths = [np.array([_path_vector(page.vectors[p]) for p in page.paths]).reshape(-1, _PATH) for page in pages]
    return [np.concatenate([a, b], 1) for a, b in zip(paths, rests(pages), strict=True)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiLstm:
    """A bidirectional LSTM with one logistic output a step, with its own training."""

    def __init__(self, hidden: int = 16, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.w = {}
        for side in "fb":
            self.w[f"x{side}"] = rng.normal(0, 0.15, (INPUTS, 4 * hidden))
            self.w[f"h{side}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
            bias = np.zeros(4 * hidden)
            bias[hidden : 2 * hidden] = 1
            self.w[f"b{side}"] = bias
        self.w["o"] = rng.normal(0, 0.3, (2 * hidden, 1))
        self.w["c"] = np.zeros(1)
        self.known: dict[bytes, np.ndarray] = {}  # a path's part of the gates

    def _run(self, gates: np.ndarray, mask: np.ndarray) -> list[tuple]:
        """Both directions side by side over (steps, 2, pages, 4 hidden); masked steps carry the state on."""
        n = self.hidden
        h, c = (np.zeros((2, gates.shape[2], n)) for _ in range(2))
        inner = np.stack([self.w["hf"], self.w["hb"]])
        steps: list[tuple] = []
        for z, m in zip(gates, mask[..., None], strict=True):
            z = z + h @ inner
            ifo, g = _sigmoid(z[..., : 3 * n]), np.tanh(z[..., 3 * n :])
            c1 = np.where(m, ifo[..., n : 2 * n] * c + ifo[..., :n] * g, c)
            th = np.tanh(c1)
            h1 = np.where(m, ifo[..., 2 * n :] * th, h)
            steps.append((h, c, ifo, g, th, h1))
            h, c = h1, c1
        return steps

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """One logit a step from a batch of inputs (steps, pages, INPUTS)."""
        x = np.concatenate([x @ self.w[f"x{s}"] + self.w[f"b{s}"] for s in "fb"], 2)
        n = 4 * self.hidden
        # The second direction reads the steps from the last to the first.
        steps = self._run(np.stack([x[:, :, :n], x[::-1, :, n:]], 1), np.stack([mask, mask[::-1]], 1))
        found = np.stack([s[-1] for s in steps])
        both = np.concatenate([found[:, 0], found[::-1, 1]], 2)
        out = (both @ self.w["o"])[:, :, 0] + self.w["c"]
        return (out, steps, both) if keep else out

    def _gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        n = self.hidden
        out, steps, both = self.logits(x, mask, keep=True)
        d = (_sigmoid(out) - y) * mask / mask.sum()
        g = {"o": np.einsum("tbh,tb->h", both, d)[:, None], "c": d.sum(keepdims=True).ravel()}
        back = d[:, :, None] * self.w["o"][:, 0]
        back = np.stack([back[:, :, :n], back[::-1, :, n:]], 1)
        masks = np.stack([mask, mask[::-1]], 1)[..., None]
        inner = np.stack([self.w["hf"].T, self.w["hb"].T])
        dh_next, dc_next = (np.zeros(back.shape[1:]) for _ in range(2))
        dz = np.zeros((*back.shape[:3], 4 * n))
        for t in range(len(x) - 1, -1, -1):
            _, c, ifo, gg, th, _ = steps[t]
            i, f, o = ifo[..., :n], ifo[..., n : 2 * n], ifo[..., 2 * n :]
            dh = back[t] + dh_next
            dc = dh * o * (1 - th**2) + dc_next
            dz[t, ..., : 3 * n] = np.concatenate([dc * gg, dc * c, dh * th], -1) * ifo * (1 - ifo)
            dz[t, ..., 3 * n :] = dc * i * (1 - gg**2)
            dz[t] *= masks[t]
            dh_next = np.where(masks[t], dz[t] @ inner, dh)
            dc_next = np.where(masks[t], dc * f, dc_next)
        before = np.stack([s[0] for s in steps])
        for k, side in enumerate("fb"):
            mine = dz[:, k].reshape(-1, 4 * n)
            g[f"x{side}"] = (x if side == "f" else x[::-1]).reshape(-1, INPUTS).T @ mine
            g[f"h{side}"] = before[:, k].reshape(-1, n).T @ mine
            g[f"b{side}"] = mine.sum(0)
        return g

    def fit(self, xs: list[np.ndarray], ys: list[np.ndarray], epochs: int = 12, batch: int = 32, rate: float = 0.01, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        step, total = 0, epochs * -(-len(xs) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(xs))
            # Pages of like length share a batch, so little of it is padding.
            order = order[np.argsort([len(xs[i]) for i in order], kind="stable")]
            for lo in rng.permutation(np.arange(0, len(xs), batch)):
                some = order[lo : lo + batch]
                x, mask = padded([xs[i] for i in some])
                y = np.zeros(mask.shape)
                for b, i in enumerate(some):
                    y[: len(ys[i]), b] = ys[i]
                step += 1
                now = rate * min(1, 2 * (1 - step / (total + 1)))
                for k, g in self._gradients(x, mask, y).items():
                    g = np.clip(g, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.w[k] = self.w[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)

    def gates(self, page: Blocks, rest: np.ndarray, lo: int, hi: int, side: str) -> np.ndarray:
        """What blocks lo to hi add to the gates of one direction. Paths recur, so their part of both is remembered."""
        n = 4 * self.hidden
        at = slice(0, n) if side == "f" else slice(n, 2 * n)
        found = np.empty((hi - lo, n))
        for k, path in enumerate(page.paths[lo:hi]):
            part = self.known.get(path)
            if part is None:
                if len(self.known) > 20_000:
                    self.known.clear()
                vector = _path_vector(page.vectors[path])
                part = self.known[path] = np.concatenate([vector @ self.w[f"x{s}"][:_PATH] + self.w[f"b{s}"] for s in "fb"])
            found[k] = part[at]
        return found + rest[lo:hi] @ self.w[f"x{side}"][_PATH:]

    def _swept(self, pages: list[Blocks], rests_: list[np.ndarray], side: str) -> np.ndarray:
        """One direction over a batch: each step's part of the output's sum, (steps, pages); gates are made piece by piece."""
        n, steps = self.hidden, max(len(p.texts) for p in pages)
        h, c = np.zeros((len(pages), n)), np.zeros((len(pages), n))
        weight = self.w["o"][:n, 0] if side == "f" else self.w["o"][n:, 0]
        out = np.zeros((steps, len(pages)))
        pieces = [(lo, min(lo + _STEPS, steps)) for lo in range(0, steps, _STEPS)]
        for lo, hi in pieces if side == "f" else reversed(pieces):
            parts = [self.gates(p, r, lo, min(hi, len(p.texts)), side) if len(p.texts) > lo else np.zeros((0, 4 * n)) for p, r in zip(pages, rests_, strict=True)]
            z, mask = padded(parts, hi - lo)
            for t in range(hi - lo) if side == "f" else range(hi - lo - 1, -1, -1):
                now, m = z[t] + h @ self.w[f"h{side}"], mask[t][:, None]
                ifo, g = _sigmoid(now[:, : 3 * n]), np.tanh(now[:, 3 * n :])
                c = np.where(m, ifo[:, n : 2 * n] * c + ifo[:, :n] * g, c)
                h = np.where(m, ifo[:, 2 * n :] * np.tanh(c), h)
                out[lo + t] = h @ weight
        return out

    def main_blocks(self, pages: list[Blocks], batch: int = 64) -> list[np.ndarray]:
        """For each page, which blocks belong to the main text; pages of like length run together.

        Beside the pages themselves, memory holds two numbers a block and the gates of `_STEPS` blocks a page.
        """
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = [i for i in np.argsort([len(p.texts) for p in pages], kind="stable") if pages[i].texts]
        while order:
            most = len(pages[order[-1]].texts)
            some = [order.pop() for _ in range(min(len(order), max(1, min(batch, 200_000 // most))))]
            mine = [pages[i] for i in some]
            facts = rests(mine)
            logits = self._swept(mine, facts, "f") + self._swept(mine, facts, "b") + self.w["c"]
            for b, i in enumerate(some):
                out[i] = logits[: len(pages[i].texts), b] > 0
        return out


def padded(xs: list[np.ndarray], steps: int = 0) -> tuple[np.ndarray, np.ndarray]:
    steps = steps or max(len(x) for x in xs)
    x, mask = np.zeros((steps, len(xs), xs[0].shape[1])), np.zeros((steps, len(xs)), bool)
    for b, page in enumerate(xs):
        x[: len(page), b], mask[: len(page), b] = page, True
    return x, mask


_TRUE = "\u2063"  # an invisible character in the main text of generated layouts


def layouts(words_: list[str], n: int, seed: int) -> list[str]:
    """Generated pages: an article among boxes of many kinds, some of them inside it; its own text holds _TRUE."""
    rng, words_ = np.random.default_rng(seed), np.array(words_)
    plain = lambda lo, hi: " ".join(rng.choice(words_, int(rng.integers(lo, hi))))
    pick = lambda *x: x[rng.integers(len(x))]
    main = lambda lo, hi: _TRUE + plain(lo, hi)
    scale = lambda lo, hi: int(np.exp(rng.uniform(np.log(lo), np.log(hi))))
    long = lambda mark: mark + " ".join(rng.choice(words_, scale(1, 600)))
    prefixes = ("", "", "site-", "page-", "main-", "global-", "js-", "block-", "article-", "post-")
    link = lambda text: f'<a href="/x">{text}</a>'

    def name(words: list[str]) -> str:
        word = str(rng.choice(words))
        return str(rng.choice(prefixes)) + word if rng.random() < 0.8 else word + "-" + pick("box", "list", "wrap", "inner", "area", "posts", "items")

    def inner() -> str:
        para = lambda: f"<p>{long('')}{pick('.', '.', '', '!')}</p>"
        kinds = (
            lambda: "<ul>" + "".join(f"<li>{link(plain(1, 4))}</li>" for _ in range(rng.integers(2, 7))) + "</ul>",
            para,
            lambda: f"<h3>{plain(1, 5)}</h3>{para()}",
            lambda: "".join(f"<div class='item'><b>{plain(1, 3)}</b>{para()}</div>" for _ in range(rng.integers(1, 4))),
            lambda: plain(2, 20),
            lambda: f"<span>{plain(2, 8)}</span> {link(plain(1, 4))}",
            lambda: f"<p>{plain(2, 9)}</p><p>{plain(20, 90)}.</p><p>{plain(20, 60)}.</p>",
        )
        return pick(*kinds)()

    def bare() -> str:
        """A box whose name, if it has one, says nothing: some letters and a digit. Readers' comments often stand in such."""
        attribute = "" if rng.random() < 0.4 else f' {pick("class", "id")}="{"".join(rng.choice(list("bcdfgkmpqrtvxz"), int(rng.integers(1, 6))))}{pick("", "1", "7", "-x")}"'
        reply = lambda: f"<{inside}><b>{plain(1, 3)}</b> <span>{plain(1, 4)}</span><p>{long('')}{pick('.', '!', '', '?')}</p></{inside}>"
        tag, inside = pick("div", "section", "div"), pick("div", "li", "section")
        return f"<{tag}{attribute}>" + (inner() if rng.random() < 0.5 else f"<h3>{plain(1, 4)}</h3>" + "".join(reply() for _ in range(rng.integers(1, 6)))) + f"</{tag}>"

    def box() -> str:
        if rng.random() < 0.3:
            tag = pick("nav", "footer", "aside", "header", "form", "dialog", "menu", "button", "fieldset")
            attribute = f' class="{name(FRAMES)}"' if rng.random() < 0.2 else ""
            return f"<{tag}{attribute}>{inner()}</{tag}>"
        tag = pick("div", "section", "ul", "aside", "div", "div")
        return f'<{tag} {pick("class", "class", "id", "role")}="{name(CUES)}">{inner()}</{tag}>'

    def body(depth: int = 0) -> str:
        para = lambda: f"<p>{long(_TRUE)}{pick('.', '.', '', '?')}</p>"
        kinds = (
            para, para, para, para, para,
            lambda: f"<h2>{main(1, 8)}</h2>",
            lambda: "<ul>" + "".join(f"<li>{main(2, 15)}</li>" for _ in range(rng.integers(1, 5))) + "</ul>",
            lambda: "<ol>" + "".join(f"<li>{link(main(2, 15))}</li>" for _ in range(rng.integers(1, 4))) + "</ol>",
            lambda: f"<blockquote>{main(5, 30)}</blockquote>",
            lambda: f"<p>{main(2, 20)} {link(plain(1, 4))} {plain(2, 9)}.</p>",
            lambda: f"<p><b>{main(2, 20)}<br><p>{long(_TRUE)}</p>",
            lambda: f"<p>{main(1, 2)}.</p>",
            lambda: f"<p>{link(main(1, 6))}</p>",
            lambda: f"<div>{para()}</div>",
            lambda: f'<div class="{name(FRAMES)}">{para()}{para()}</div>',
            lambda: f"<section>{para()}{para()}</section>",
            lambda: f"<table><tr><th>{main(1, 3)}</th></tr><tr><td>{main(1, 6)}</td><td>{main(1, 6)}</td></tr></table>",
            lambda: f"<figure><figcaption>{main(2, 9)}</figcaption></figure>",
            lambda: f"<pre>{main(2, 9)}</pre>",
            lambda: f"<p>{main(1, 4)} <math><mi>{plain(1, 2)}</mi></math></p>",
            lambda: f"<noscript><p>{main(3, 9)}</p></noscript>",
        )
        return "".join(box() if rng.random() < 0.12 else pick(*kinds)() for _ in range(scale(1, 40)))

    def head() -> str:
        kinds = (lambda: f"<header><h1>{main(2, 10)}</h1></header>", lambda: f"<h1>{main(2, 10)}</h1>", lambda: f"<h1>{main(2, 10)}</h1>", lambda: "")
        return pick(*kinds)()

    frames = (
        ("<article>", "</article>"), ("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ('<div role="main">', "</div>"), ("<main><article>", "</article></main>"), ("<div>", "</div>"),
    )
    pages = []
    for _ in range(n):
        opened, closed = pick(*frames)
        if rng.random() < 0.25:  # an article by its class alone, or one that has a class too
            opened = pick(f'<div class="{name(FRAMES)}">', f'<article class="{name(FRAMES)}">', f'<section id="{name(FRAMES)}">', f'<article class="{rng.choice(CUES)}-{pick("open", "on", "enabled")}">')
            closed = f"</{opened[1:].split(' ')[0]}>"
        # Names on the page's own frame say nothing about what is in it.
        outer = f' class="{pick("has", "with", "no")}-{rng.choice(CUES)}"' if rng.random() < 0.3 else ""
        wrap = pick(("", ""), ("", ""), ("<div>", "</div>"), (f'<div class="{name(FRAMES)}">', "</div>"), (f'<div class="{pick("has", "with")}-{rng.choice(CUES)}">', "</div>"))
        # Only beside an article that its tag or role sets apart a box without a telling name can be told from it.
        bare_share = 0.3 if opened.startswith(("<article", "<main", '<div role="main"')) else 0.0
        around = lambda: "".join(bare() if rng.random() < bare_share else box() for _ in range(rng.integers(0, 5)))
        pages.append(f"<html><body{outer}>{around()}{wrap[0]}{opened}{head()}{body()}{closed}{wrap[1]}{around()}</body></html>")
    return pages


def truth(page: Blocks) -> np.ndarray:
    """Labels of a generated page; the marks are taken out of its texts."""
    y = np.array([_TRUE in t for t in page.texts], float)
    page.texts[:] = [t.replace(_TRUE, "") or "-" for t in page.texts]
    return y


def recurring(pages: list[Blocks], least: int = 3) -> list[np.ndarray]:
    """Which blocks of each page lie on a path most of whose texts stand on `least` pages or more."""
    on = Counter(t for p in pages for t in set(p.texts))
    often: dict[bytes, list[bool]] = {}
    for page in pages:
        for path, text in zip(page.paths, page.texts, strict=True):
            often.setdefault(path, []).append(on[text] >= least)
    return [np.array([2 * sum(often[p]) > len(often[p]) for p in page.paths], bool) for page in pages]


def trained(pages: list[str], generated: int = 1500, most_steps: int = 120, epochs: int = 12) -> BiLstm:
    """Fits the labeller on generated layouts, then on these and sampled pages; long pages by pieces.

    A sampled page takes the first fit's labels, but a block that recurs on other pages is no main text.
    """
    own = [b for b in map(blocks, dict.fromkeys(pages)) if b.texts]
    vocabulary = sorted({w for b in own for t in b.texts for w in t.split()})[:5000] or ["text"]
    made = [blocks(p) for p in layouts(vocabulary, generated, 11)]
    known = [truth(b) for b in made]
    pieces = lambda xs: [x[lo : lo + most_steps] for x in xs for lo in range(0, len(x), most_steps)]
    xs, ys = pieces(vectors(made)), pieces(known)
    model = BiLstm()
    model.fit(xs, ys, epochs=epochs)
    if own:
        guessed = [np.where(again, 0.0, found.astype(float)) for found, again in zip(model.main_blocks(own), recurring(own), strict=True)]
        model.fit(xs + pieces(vectors(own)), ys + pieces(guessed), epochs=3, rate=0.003)
        model.known.clear()
    return model


def main_text(pages: DataFrame, sample: int = 200, most_chars: int = 1 << 18) -> DataFrame:
    """page_id, url, text, n_chars for every row of `pages`; null or empty html gives an empty text.

    The labeller is fitted on the `sample` pages of least id hash (then id and html), whole ones,
    among those of at most `most_chars` characters; every page is labelled, whatever its length.
    Blocks are joined by newlines, in page order; white space within a block becomes one space.
    Repeated rows give repeated rows, other columns are left out, an empty table gives none.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    # For training alone. Keys are chosen first, so no page but the sample's goes to the driver.
    short = rows.filter(F.col("html").isNotNull() & (F.length("html") <= most_chars)).withColumn("mark", F.md5("html"))
    chosen = short.select("page_id", "mark").orderBy(F.xxhash64(F.lit(7), "page_id"), "page_id", "mark").limit(sample)
    chosen = chosen.select(F.col("page_id").alias("id"), F.col("mark").alias("own")).distinct()
    of = short["page_id"].eqNullSafe(chosen["id"]) & (short["mark"] == chosen["own"])
    some = short.join(F.broadcast(chosen), of, "left_semi").dropDuplicates(["page_id", "mark"]).orderBy("page_id", "mark").select("html").collect()
    at = pages.sparkSession.sparkContext.broadcast(trained([r[0] for r in some]).w)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = BiLstm()
        model.w = at.value
        for batch in slices(batches, "html", 1 << 21):
            split = [blocks(v.as_py() or "") for v in batch.column("html")]
            texts = ["\n".join(t for t, good in zip(p.texts, keep, strict=True) if good) for p, keep in zip(split, model.main_blocks(split), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return rows.mapInArrow(label, "page_id long, url string, text string, n_chars long")
