"""Main text of web pages with a recurrent block labeller.

A page is read into its leaf blocks, stretches of text between block-level tags.
A bidirectional LSTM (numpy) reads the sequence of blocks, each as a vector of its
hashed tag path (names, classes and ids of its ancestors), hashed words and a few
statistics, and says for every block whether it belongs to the main text, with
the whole page as context.

It is fitted on generated pages of many layouts, whose labels are known, and on a
bounded sample of given pages that name their parts by HTML's sectioning tags.
"""

from __future__ import annotations

import random
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailgrain.llm import packed as k

PATH, WORDS, STATS = 64, 32, 8
WIDTH = PATH + WORDS + STATS
HIDDEN = 16
GENERATED, SAMPLE, SAMPLE_CHARS = 500, 300, 20_000
EPOCHS = 5
PAGES_AT_ONCE = 256
CELLS = 1 << 15
SLICE_BYTES = 4 << 20

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data dfn del em font i ins kbd label mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr img math mi mo mn ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder "
    "munderover mstyle mspace mpadded mphantom menclose semantics".split())
# Parts of their own that may stand inside a paragraph.
EMBEDDED = frozenset("svg object canvas iframe audio video noscript mtable mtr mtd annotation".split())
# What no reader sees as text; a title counts only outside a drawing, where it names the page.
DROPPED = frozenset("script style template title".split())
# Start tags that leave an open head open.
IN_HEAD = frozenset("html head title meta link base basefont bgsound script style noscript noframes template".split())
CLOSES_ITSELF = frozenset("p li dt dd option tr td th".split())
OTHER_PARTS = frozenset("nav header footer aside form menu".split())


class Reader(HTMLParser):
    """Blocks of a page: text, path number, characters inside links."""

    def __init__(self, paths: dict):
        super().__init__(convert_charrefs=True)
        self.paths, self.blocks, self.text, self.linked = paths, [], [], 0
        self.stack, self.open, self.path = [], {}, 0
        self.dropped = self.links = 0

    def flush(self):
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.blocks.append((text, self.path, self.linked))
            self.text = []
        self.linked = 0

    def push(self, tag, token):
        dropped = tag in DROPPED and not (tag == "title" and self.open.get("svg"))
        self.stack.append((tag, self.path, dropped))
        self.open[tag] = self.open.get(tag, 0) + 1
        if token is not None:
            self.path = self.paths.setdefault((self.path, token), len(self.paths) + 1)
        self.dropped += dropped
        self.links += tag == "a"

    def pop(self):
        tag, self.path, dropped = self.stack.pop()
        self.open[tag] -= 1
        self.dropped -= dropped
        self.links -= tag == "a"
        return tag

    def handle_starttag(self, tag, attrs):
        inline = tag in INLINE
        # HTML allows to leave </head> out: what cannot be in a head ends it, with an open title unless the tag is inline.
        if self.open.get("head") and tag not in IN_HEAD and not self.open.get("template") and not (inline and self.open.get("title")):
            self.handle_endtag("head")
        if not inline:
            self.flush()
        if not inline and tag not in EMBEDDED:
            # A block inside an open paragraph, and a second item of a list, end the first.
            for own in ("p", tag) if tag in CLOSES_ITSELF else ("p",):
                if self.open.get(own):
                    depth = next((d for d, (t, *_) in enumerate(reversed(self.stack)) if t not in INLINE), None)
                    if depth is not None and self.stack[-1 - depth][0] == own:
                        for _ in range(depth + 1):
                            self.pop()
        if tag not in VOID:
            names = [v for a, v in attrs if a in ("class", "id", "role") and v]
            self.push(tag, None if inline else (tag, *" ".join(names).lower().split()))

    def handle_startendtag(self, tag, attrs):
        if tag not in INLINE:
            self.flush()

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.flush()
        if self.open.get(tag):
            while self.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.dropped:
            if self.open.get("head") and data.strip():
                self.handle_endtag("head")
            self.text.append(data)
            if self.links:
                self.linked += len(data)


def read_page(html: str | None, paths: dict) -> list[tuple[str, int, int]]:
    reader = Reader(paths)
    reader.feed(html or "")
    reader.close()
    reader.flush()
    return reader.blocks


def name_hash(*names: str) -> int:
    out = 0
    for c in "\0".join(names).encode():
        out = (out * 0x100000001B3 + c + 1) & k.MASK
    return int(k.mix(np.array([out], k.U), 70)[0] % PATH)


def path_vectors(paths: dict) -> np.ndarray:
    """One row per path number: ancestors' names, and the last two with their place."""
    out = np.zeros((len(paths) + 1, PATH), np.float32)
    tags = {0: ""}
    memo: dict[tuple, int] = {}

    def spot(*names):
        if names not in memo:
            memo[names] = name_hash(*names)
        return memo[names]

    base = np.zeros((len(paths) + 1, PATH), np.float32)
    for (parent, token), number in paths.items():
        base[number] = base[parent]
        for i, name in enumerate(token):
            base[number, spot("tag" if i == 0 else "name", name)] = 1
        out[number] = base[number]
        out[number, spot("last", token[0])] += 1
        out[number, spot("pair", tags[parent], token[0])] += 1
        tags[number] = token[0]
    return out


def block_vectors(pages: list[list[tuple[str, int, int]]], paths: dict) -> np.ndarray:
    """One row per block of all pages."""
    count = np.array([len(p) for p in pages], np.int64)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return vectors_of([b for page in pages for b in page], place, np.repeat(count, count), path_vectors(paths))


def vectors_of(blocks: list[tuple[str, int, int]], place: np.ndarray, of: np.ndarray, known: np.ndarray) -> np.ndarray:
    """One row per block, given its place in its page, the page's number of blocks, and the vectors of all paths."""
    texts = pa.array([b[0] for b in blocks], pa.large_string())
    data, bounds = k.utf8(texts)
    start, stop, first = k.words_of(data, bounds)
    n_words = np.diff(first)
    doc = np.repeat(np.arange(len(blocks)), n_words)
    word = (k.word_hashes(np.where((data > 64) & (data < 91), data + 32, data).astype(np.uint8), start, stop)
            % k.U(WORDS)).astype(np.int64)
    bag = np.bincount(doc * WORDS + word, minlength=len(blocks) * WORDS).reshape(len(blocks), WORDS)
    ends = np.isin(data[stop - 1], np.frombuffer(b".!?", np.uint8)) if len(stop) else np.zeros(0, bool)
    sentence = np.bincount(doc, ends, minlength=len(blocks))
    size = np.array([len(b[0]) for b in blocks], np.int64)
    stats = np.stack([
        np.log1p(size) / 8, np.log1p(n_words) / 6, np.minimum(np.array([b[2] for b in blocks]) / np.maximum(size, 1), 1),
        np.minimum(sentence, 5) / 5, sentence / np.maximum(n_words, 1), (place + 1) / (of + 1), 1 - (place + 1) / (of + 1),
        np.log1p(of) / 6], axis=1) if len(blocks) else np.zeros((0, STATS))
    return np.hstack([
        known[[b[1] for b in blocks]], bag / np.sqrt(np.maximum(n_words, 1))[:, None], stats
    ]).astype(np.float32)


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, pages))
    x = np.zeros((longest, len(pages), pages[0].shape[-1]), np.float32)
    mask = np.zeros((longest, len(pages)), np.float32)
    for i, p in enumerate(pages):
        x[: len(p), i], mask[: len(p), i] = p, 1
    return x, mask


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Labeller:
    """Weights: for each direction input, state and bias of the four gates; then the output."""

    weights: dict[str, np.ndarray]

    @staticmethod
    def fresh(seed: int = 11) -> Labeller:
        r = np.random.default_rng(seed)
        w = {}
        for d in "fb":
            w[f"x{d}"] = r.normal(0, 1 / WIDTH ** 0.5, (WIDTH, 4 * HIDDEN))
            w[f"h{d}"] = r.normal(0, 1 / HIDDEN ** 0.5, (HIDDEN, 4 * HIDDEN))
            w[f"c{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        w["o"], w["i"], w["e"] = r.normal(0, 0.2, 2 * HIDDEN), np.zeros(WIDTH), np.zeros(1)
        return Labeller({n: v.astype(np.float32) for n, v in w.items()})

    def direction(self, d, x, mask, h, c, trace=None):
        """States of one direction from a given start, and where it ends."""
        w = self.weights
        pre = x @ w[f"x{d}"] + w[f"c{d}"]
        out = np.zeros((*x.shape[:2], HIDDEN), np.float32)
        for t in range(len(x)) if d == "f" else reversed(range(len(x))):
            z = pre[t] + h @ w[f"h{d}"]
            gate = sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gate[:, :HIDDEN], gate[:, HIDDEN: 2 * HIDDEN], gate[:, 2 * HIDDEN:]
            g, m = np.tanh(z[:, 3 * HIDDEN:]), mask[t][:, None]
            new = f * c + i * g
            tanh = np.tanh(new)
            if trace is not None:
                trace.append((d, t, i, f, o, g, c, h, tanh, m))
            # Outside a page the state stays empty.
            c, h = m * new, m * o * tanh
            out[t] = h
        return out, h, c

    def forward(self, x, mask, trace=None):
        w = self.weights
        empty = np.zeros((x.shape[1], HIDDEN), np.float32)
        both = np.concatenate([self.direction(d, x, mask, empty, empty, trace)[0] for d in "fb"], axis=2)
        return both @ w["o"] + x @ w["i"] + w["e"], both

    def long_page(self, n: int, rows) -> np.ndarray:
        """Scores of one page of n blocks, whose vectors ``rows(low, high)`` gives part by part."""
        w = self.weights
        score = np.full(n, w["e"][0], np.float32)
        for d, out in (("f", w["o"][:HIDDEN]), ("b", w["o"][HIDDEN:])):
            h = c = np.zeros((1, HIDDEN), np.float32)
            for low in range(0, n, CELLS) if d == "f" else reversed(range(0, n, CELLS)):
                x = rows(low, min(low + CELLS, n))[:, None]
                state, h, c = self.direction(d, x, np.ones(x.shape[:2], np.float32), h, c)
                score[low: low + len(x)] += state[:, 0] @ out
                if d == "f":
                    score[low: low + len(x)] += x[:, 0] @ w["i"]
        return score

    def gradients(self, x, mask, label):
        trace: list = []
        raw, both = self.forward(x, mask, trace)
        w = self.weights
        slope = (sigmoid(raw) - label) * mask / mask.sum()
        grad = {"o": np.einsum("tb,tbh->h", slope, both), "i": np.einsum("tb,tbw->w", slope, x), "e": slope.sum(keepdims=True)[0]}
        below = {d: np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32) for d in "fb"}
        for d in "fb":
            grad[f"h{d}"] = np.zeros_like(w[f"h{d}"])
        last = None
        for d, t, i, f, o, g, c, h, tanh, m in reversed(trace):
            if d != last:
                dh = dc = np.zeros_like(h)
                last = d
            part = w["o"][:HIDDEN] if d == "f" else w["o"][HIDDEN:]
            dh = (dh + slope[t][:, None] * part) * m
            dn = dc * m + dh * o * (1 - tanh ** 2)
            dz = np.concatenate([dn * g * i * (1 - i), dn * c * f * (1 - f), dh * tanh * o * (1 - o), dn * i * (1 - g ** 2)], axis=1)
            below[d][t] = dz
            grad[f"h{d}"] += h.T @ dz
            dh, dc = dz @ w[f"h{d}"].T, dn * f
        flat = x.reshape(-1, WIDTH)
        for d in "fb":
            grad[f"x{d}"] = flat.T @ below[d].reshape(-1, 4 * HIDDEN)
            grad[f"c{d}"] = below[d].sum(axis=(0, 1))
        return grad

    def is_main(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Which blocks of each page, given its vectors, are main text."""
        return self.label([len(p) for p in pages], lambda own, low, high: [pages[i][low:high] for i in own])

    def label(self, sizes: list[int], rows) -> list[np.ndarray]:
        """Which blocks of each page are main text; ``rows(pages, low, high)`` gives vectors of these blocks.

        Pages of similar length go together, padded to at most CELLS blocks; longer ones go alone and part by part.
        """
        out: list = [np.zeros(0, bool)] * len(sizes)
        group: list[int] = []

        def flush():
            if group:
                raw, _ = self.forward(*padded(rows(group, 0, CELLS)))
                for j, i in enumerate(group):
                    out[i] = raw[: sizes[i], j] > 0
            group.clear()

        for i in sorted((i for i in range(len(sizes)) if sizes[i]), key=lambda i: sizes[i]):
            if len(group) == PAGES_AT_ONCE or (len(group) + 1) * sizes[i] > CELLS:
                flush()
            if sizes[i] > CELLS:
                out[i] = self.long_page(sizes[i], lambda low, high: rows([i], low, high)[0]) > 0
            else:
                group.append(i)
        flush()
        return out


def fit(pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, batch: int = 32, rate: float = 0.01) -> Labeller:
    """Adam on batches of pages of similar length."""
    model = Labeller.fresh()
    r = np.random.default_rng(5)
    order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
    groups = [order[a: a + batch] for a in range(0, len(order), batch)]
    mean, square = ({n: np.zeros_like(v) for n, v in model.weights.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        for g in r.permutation(len(groups)):
            own = groups[g]
            x, mask = padded([pages[i] for i in own])
            y, _ = padded([labels[i][:, None].astype(np.float32) for i in own])
            step += 1
            for n, grad in model.gradients(x, mask, y[:, :, 0]).items():
                mean[n] = 0.9 * mean[n] + 0.1 * grad
                square[n] = 0.99 * square[n] + 0.01 * grad ** 2
                model.weights[n] -= (rate * 0.7 ** epoch * (mean[n] / (1 - 0.9 ** step)) / (
                    np.sqrt(square[n] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return model


# -- pages to learn from ----------------------------------------------------

class Generator:
    """Pages of random layout; main text is wrapped in U+0001 and U+0002 so that its blocks are known."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        letters = ["".join(self.r.choice("bcdfglmnprstvw") + self.r.choice("aeiouäéo") for _ in range(self.r.randint(1, 3)))
                   for _ in range(400)]
        self.words = letters + ["the", "of", "and", "in", "to", "a", "is", "de", "la", "der", "die"] * 8

    def some(self, low, high):
        return " ".join(self.r.choice(self.words) for _ in range(self.r.randint(low, high)))

    def prose(self):
        out = [self.some(3, 18).capitalize() + self.r.choice(".....!?") for _ in range(self.r.randint(1, 6))]
        if self.r.random() < 0.15:
            out = [self.some(1, 3).capitalize() + self.r.choice(("", "."))]
        if self.r.random() < 0.1:
            out = [" | ".join(self.some(1, 1) for _ in range(self.r.randint(3, 30)))]
        return " ".join(out)

    def link(self, low=1, high=3):
        return f'<a href="/{self.r.randint(1, 999)}">{self.some(low, high)}</a>'

    def box(self, tag, names, inside):
        r = self.r
        if r.random() < 0.55:
            tag = r.choice(("div", "section", "div"))
        name = r.choice(names) + r.choice(("", "", "-box", "s", f"-{r.randint(1, 9)}"))
        attribute = r.choice((f' class="{name}"', f' id="{name}"', f' class="{self.some(1, 1)} {name}"'))
        return f"<{tag}{attribute if r.random() < 0.85 or tag in ('div', 'section') else ''}>{inside}</{tag}>"

    def menu(self):
        r = self.r
        links = [self.link(1, 2) for _ in range(r.randint(3, 10))]
        inside = "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>" if r.random() < 0.7 else " | ".join(links)
        return self.box("nav", ("nav", "menu", "navigation", "topbar", "breadcrumb"), inside)

    def extra(self):
        r = self.r
        kind = r.randrange(6)
        if kind == 0:
            return self.box("div", ("ad", "ads", "advert", "sponsored", "promo", "banner"), self.r.choice((self.prose(), f"<p>{self.prose()}</p>")))
        if kind == 1:
            return self.box("aside", ("sidebar", "related", "widget", "aside"),
                            f"<h3>{self.some(1, 3)}</h3>" + "".join(r.choice((f"<p>{self.prose()}</p>", f"<li>{self.link(2, 6)}</li>"))
                                                                 for _ in range(r.randint(1, 5))))
        if kind == 2:
            return self.box("div", ("cookie", "notice", "consent", "alert", "message"),
                            f"<p>{r.choice(('We use cookies', 'Please accept our terms', self.some(4, 9)))}. {self.some(3, 9)}</p><button>{self.some(1, 2)}</button>")
        if kind == 3:
            return f"<form action='/s'><label>{self.some(1, 3)}</label><input name=q><p>{self.some(2, 8)}</p><button>{self.some(1, 2)}</button></form>"
        if kind == 4:
            return self.box("div", ("share", "social", "tags", "meta", "author"), " ".join(self.link() for _ in range(r.randint(2, 5))))
        return self.box("div", ("newsletter", "subscribe", "login", "search"), f"<p>{self.some(3, 12)}.</p><input><button>{self.some(1, 2)}</button>")

    def comments(self):
        r = self.r
        return self.box("section", ("comment", "comments", "discussion", "responses", "replies"), f"<h3>{r.choice(('Comments', 'Replies', self.some(1, 2)))}</h3>" + "".join(
            f'<div class="{r.choice(("comment", "reply", "post-comment", "c"))}"><b>{self.some(1, 2)}</b><p>{self.prose()}</p></div>'
            for _ in range(r.randint(1, 6))))

    def fallback(self):
        """Embedded parts outside the main text."""
        r = self.r
        text = r.choice(("Please enable JavaScript", "Your browser does not support this", self.some(1, 8))) + r.choice((".", ""))
        return r.choice((
            f"<noscript>{text}</noscript>", f"<noscript><p>{text}</p></noscript>", f"<iframe src=/x>{text}</iframe>",
            f"<video src=/v>{text}</video>", f'<object data=/o><p>{text}</p></object>',
            f'<a href="/"><svg><title>{self.some(1, 2)}</title><path d="M0 0"/></svg></a>', f"<canvas>{text}</canvas>"))

    def embedded(self, mark):
        """Embedded parts of the main text."""
        some = self.some
        return self.r.choice((
            f"<noscript><p>{mark(self.prose())}</p></noscript>", f"<noscript>{mark(self.prose())}</noscript>",
            f"<object data=/o><p>{mark(self.prose())}</p></object>", f"<p>{mark(self.prose())}<canvas>{mark(some(2, 9))}</canvas>{mark(self.prose())}</p>",
            f"<svg><title>{mark(some(1, 4))}</title><text>{mark(some(1, 5))}</text></svg>",
            f"<p>{mark(f'{some(2, 9)} <math><mi>x</mi><mo>=</mo><mn>2</mn></math> {some(2, 9)}.')}</p>"))

    def main(self):
        r = self.r

        def mark(text):
            return f"\1{text}\2"

        out = [f"<h1>{mark(self.some(2, 12))}</h1>"] if r.random() < 0.85 else []
        for _ in range(r.randint(1, 14) if r.random() < 0.96 else r.randint(40, 120)):
            kind, close = r.random(), "</p>" if r.random() < 0.7 else ""
            if kind < 0.7:
                text = self.prose()
                out.append(r.choice((f"<p>{mark(text)}{close}", f"<p><b>{mark(text)}<br>{close}", f"<p>{mark(f'<i>{text}</i>')}{close}")))
            elif kind < 0.78:
                out.append(f"<h2>{mark(self.some(1, 6))}</h2>")
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{mark(self.prose())}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif kind < 0.92:
                out.append(f"<blockquote><p>{mark(self.prose())}</p></blockquote>")
            elif kind < 0.95:
                out.append("<table>" + "".join(f"<tr><td>{mark(self.some(1, 3))}<td>{mark(self.some(1, 3))}" for _ in range(r.randint(1, 4))) + "</table>")
            elif r.random() < 0.5:
                out.append(self.extra())
        for _ in range(r.choice((0, 0, 1, 1, 2))):
            out.insert(r.choice((r.randint(0, len(out)), len(out))), self.embedded(mark))
        tag, names = r.choice((("article", ""), ("article", ' class="post"'), ("main", ""), (
            "div", f' class="{r.choice(("content", "post", "entry", "article", "story", "text", "body", "main"))}{r.choice(("", "-body", "-content"))}"'),
            ("div", f' id="{r.choice(("content", "main", "article"))}"')))
        return f"<{tag}{names}>{''.join(out)}</{tag}>"

    def page(self):
        r = self.r
        if r.random() < 0.06:
            return self.main()
        top = [self.menu()] if r.random() < 0.9 else []
        if r.random() < 0.5:
            top = [self.box("header", ("header", "masthead", "top"), f"<h2>{self.some(1, 3)}</h2>" + "".join(top))]
        before = [self.extra() for _ in range(r.choice((0, 0, 1, 1, 2)))]
        after = [self.extra() for _ in range(r.choice((0, 0, 1, 2)))] + ([self.comments()] if r.random() < 0.4 else [])
        foot = [self.box("footer", ("footer", "bottom", "copyright", "legal"), f"&copy; {self.some(1, 2)} &middot; {self.prose()}" + (
            self.link() if r.random() < 0.5 else ""))] if r.random() < 0.9 else []
        end = "</body></html>" if r.random() < 0.8 else ""
        for part in (top, before, after):
            if r.random() < 0.1:
                part.insert(r.randint(0, len(part)), self.fallback())
        title = f"<title>{self.some(2, 6)}</title>"
        start = f"<html><head>{title}</head><body>" if r.random() < 0.6 else r.choice((
            f"<html><head>{title}<body>", f"<html><head>{title}", f"<head><meta charset=utf-8>{title}<style>p{{}}</style><body>",
            f"<html>{title}<body>", title))
        return f"{start}{''.join([*top, *before, self.main(), *after, *foot])}{end}"


def generated(n: int, seed: int = 1):
    """Blocks of n generated pages, their labels, and the path numbers."""
    g, pages, labels, paths = Generator(seed), [], [], {}
    for _ in range(n):
        blocks = read_page(g.page(), paths)
        labels.append(np.array(["\1" in b[0] for b in blocks], bool))
        pages.append([(b[0].replace("\1", "").replace("\2", ""), b[1], b[2]) for b in blocks])
    return pages, labels, paths


def sectioned(html: list[str]):
    """Blocks of pages with an article or main part, labelled by HTML's sectioning tags."""
    pages, labels, paths = [], [], {}
    found = [read_page(h, paths) for h in html]
    inside, known = {0: None}, {0: False}
    for (parent, token), number in paths.items():
        part = True if token[0] in ("article", "main") else False if token[0] in OTHER_PARTS else inside[parent]
        inside[number] = part
        known[number] = known[parent] or token[0] in ("article", "main")
    for blocks in found:
        if any(known[b[1]] for b in blocks):
            pages.append(blocks)
            labels.append(np.array([bool(inside[b[1]]) for b in blocks], bool))
    return pages, labels, paths


def train(pages: DataFrame | None = None, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> Labeller:
    """A labeller fitted on generated pages and at most ``sample`` given ones of moderate length."""
    x, y = [], []
    given = []
    if pages is not None:
        html = F.col(html_col).cast("string")
        usable = pages.where(html.isNotNull() & (F.length(html) < SAMPLE_CHARS)).select(
            F.col(id_col).cast("string").alias("id"), html.alias("html"))
        chosen = usable.select("id", F.xxhash64("id").alias("h")).orderBy("h", "id").limit(sample).select("id").distinct()
        # At most ``sample`` ids are broadcast; repeated ids are cut to the sample.
        rows = usable.join(F.broadcast(chosen), "id").dropDuplicates(["id"]).collect()
        given = [r.html for r in sorted(rows, key=lambda r: r.id)]
    for blocks, labels, paths in (generated(GENERATED), sectioned(given)):
        rows = block_vectors(blocks, paths)
        edge = np.concatenate([[0], np.cumsum([len(b) for b in blocks], dtype=np.int64)])
        x += [rows[i:j] for i, j in zip(edge, edge[1:])]
        y += labels
    return fit(x, y)


def main_texts(html: list[str | None], model: Labeller) -> list[str]:
    paths: dict = {}
    pages = [read_page(h, paths) for h in html]
    known = path_vectors(paths)

    def rows(own: list[int], low: int, high: int) -> list[np.ndarray]:
        parts = [pages[i][low:high] for i in own]
        place = np.concatenate([np.arange(low, low + len(p)) for p in parts])
        of = np.repeat([len(pages[i]) for i in own], [len(p) for p in parts])
        cuts = np.cumsum([len(p) for p in parts])[:-1]
        return np.split(vectors_of([b for p in parts for b in p], place, of, known), cuts)

    main = model.label([len(p) for p in pages], rows)
    return [" ".join(b[0] for b, m in zip(page, flags) if m) for page, flags in zip(pages, main)]


def extract(pages: DataFrame, model: Labeller, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns named in ``keep``, and text: the main text of each page.

    White space inside a block becomes one space, blocks are joined by one space.
    Null pages count as empty and give an empty text, as do pages without main
    text.  Rows that repeat are extracted each; other columns are ignored; an
    empty table gives no rows.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            _, bounds = k.utf8(batch.column("_html"))
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + SLICE_BYTES, "right")) - 1)
                part = batch.slice(first, last - first)
                text = main_texts(part.column("_html").to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([*(part.column(f"keep_{c}") for c in keep), pa.array(text, pa.string())],
                                                 names=[*(f"keep_{c}" for c in keep), "text"])
                first = last

    own = pages.select(*(F.col(c).alias(f"keep_{c}") for c in keep), F.col(html_col).cast("string").alias("_html"))
    fields = "".join(f"`keep_{c}` {pages.schema[c].dataType.simpleString()}, " for c in keep)
    return own.mapInArrow(run, f"{fields}text string").withColumnsRenamed({f"keep_{c}": c for c in keep})
