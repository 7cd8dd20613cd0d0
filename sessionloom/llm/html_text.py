"""Main-text extraction with a recurrent block labeller.

A page becomes a sequence of leaf blocks: runs of text between block-level tags, each with the path
of elements above it. A block's input is the mean of learned vectors of its hashed path elements
(tags, and the words of class, id and role), the mean of learned vectors of its hashed words, and a
few numbers (length, link share, punctuation). A bidirectional LSTM in numpy reads the sequence, so
each label rests on the whole page, and a logistic layer decides block by block.

The labeller is trained here, in numpy, on generated block sequences of many page layouts
(``layouts``); training is seeded and takes some seconds on the driver.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sessionloom.llm import bytekit

#: fixed values: HTML element names
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody "
    "td textarea tfoot th thead title tr ul label".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript template svg annotation annotation-xml iframe canvas audio video title textarea select xmp".split())
#: of these, what holds code or plain text: behind one that is never closed, all up to the next tag goes
CODE_TAGS = frozenset("script style title textarea xmp".split())
#: what may stand in a head; any other element closes one whose end tag is left out
HEAD_TAGS = frozenset("head title meta link base basefont script style noscript template".split())
CLOSES_P = BLOCK_TAGS - {"body", "html", "label", "button", "option"}
SELF_NESTING = {"li": "li", "dt": "dd", "dd": "dt", "tr": "tr", "td": "td", "th": "th", "option": "option", "p": "p"}

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)[^>]*>""",
    re.S,
)
NAMES = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PIECES = re.compile(r"[a-z]+")

PATH_BUCKETS, WORD_BUCKETS = 1 << 11, 1 << 12
WIDTH, HIDDEN, NUMBERS = 12, 16, 5


@dataclass
class Block:
    path: tuple[int, ...]
    text: str
    linked: int = 0


@lru_cache(maxsize=1 << 16)
def element(tag: str, attributes: str) -> tuple[int, ...]:
    """Buckets of an element: its tag and the words of its naming attributes."""
    words = {tag}
    for m in NAMES.finditer(attributes):
        words.update("." + w for w in PIECES.findall((m[2] or m[3] or m[4] or "").lower()))
    return tuple(crc32(w.encode()) % PATH_BUCKETS for w in sorted(words))


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page, in order; broken markup is closed as browsers do."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[int, ...]]] = []
    parts: list[str] = []
    linked, links = 0, 0
    unclosed: set[str] = set()
    last = page.rfind(">") + 1

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if links:
                linked += len(text)

    def close_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(tuple(b for _, e in stack for b in e), text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def pop_to(tag: str) -> None:
        nonlocal links
        while stack:
            name, _ = stack.pop()
            links -= name == "a"
            if name == tag:
                return

    at = 0
    while True:
        m = TAG.search(page, at, last)
        if m is None:
            add(page[at:])
            close_block()
            return out
        add(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue  # a comment or declaration
        tag = tag.lower()
        if not m[1] and tag not in HEAD_TAGS and stack and stack[-1][0] == "head":
            close_block()
            pop_to("head")
        if m[1]:
            if tag in BLOCK_TAGS:
                close_block()
            if any(name == tag for name, _ in stack):
                pop_to(tag)
        elif tag in RAW_TAGS:
            if tag in BLOCK_TAGS:
                close_block()
            if not m[3].rstrip().endswith("/"):
                end = None if tag in unclosed else re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
                if end:
                    at = end.end()
                else:  # never closed: the rest of the page is not its content
                    unclosed.add(tag)
                    if tag in CODE_TAGS:
                        following = TAG.search(page, at, last)
                        at = following.start() if following else len(page)
        elif tag == "br":
            add(" ")
        elif tag in VOID_TAGS:
            if tag in BLOCK_TAGS:
                close_block()
        else:
            if tag in BLOCK_TAGS:
                close_block()
                open_tags = [name for name, _ in stack]
                if tag in CLOSES_P and "p" in open_tags:
                    pop_to("p")
                elif (twin := SELF_NESTING.get(tag)) and open_tags and tag != "p":
                    for name in reversed(open_tags):
                        if name in (tag, twin):
                            pop_to(name)
                            break
                        if name in ("ul", "ol", "dl", "table", "select", "div"):
                            break
            if not m[3].rstrip().endswith("/"):
                stack.append((tag, element(tag, m[3])))
                links += tag == "a"


def inputs(found: list[Block]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Path buckets of each block, word buckets of all blocks with their bounds, and numbers."""
    column = pa.array([b.text for b in found], pa.string())
    data, offsets = bytekit.flat(column)
    data = bytekit.LOWER[data]
    starts, ends = bytekit.words(~bytekit.SPACE[data], offsets)
    words = (bytekit.span_hash(data, starts, ends) % np.uint64(WORD_BUCKETS)).astype(np.int64)
    bounds = bytekit.row_bounds(starts, offsets)
    size = np.diff(offsets).astype(float)
    marks = np.concatenate([[0], np.cumsum(np.isin(data, np.frombuffer(b".,;:!?", np.uint8)))])
    ends_well = np.array([b.text[-1] in ".!?\"'…”»:" for b in found], float)
    numbers = np.stack(
        [
            np.log1p(size) / 6,
            np.array([b.linked for b in found]) / np.maximum(size, 1),
            np.diff(marks[offsets]) * 10 / np.maximum(size, 1),
            ends_well,
            np.log1p(np.diff(bounds)) / 4,
        ],
        1,
    )
    return [np.array(b.path or (0,)) for b in found], words, bounds, numbers


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros((len(values) + 1, values.shape[1]))
    np.cumsum(values, 0, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


@dataclass
class Labeller:
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def new(cls, seed: int) -> Labeller:
        rng = np.random.default_rng(seed)
        size = 2 * WIDTH + NUMBERS
        w = {"path": rng.normal(0, 0.3, (PATH_BUCKETS, WIDTH)), "word": rng.normal(0, 0.1, (WORD_BUCKETS, WIDTH)), "out": rng.normal(0, 0.2, (2 * HIDDEN + size, 1)), "bias": np.zeros(1)}
        for side in "fb":
            w[f"x{side}"] = rng.normal(0, 0.25, (size, 4 * HIDDEN))
            w[f"h{side}"] = rng.normal(0, 0.25, (HIDDEN, 4 * HIDDEN))
            w[f"c{side}"] = np.zeros(4 * HIDDEN)
            w[f"c{side}"][HIDDEN : 2 * HIDDEN] = 1
        return cls(w)

    def embed(self, found: list[Block]) -> tuple[np.ndarray, tuple]:
        paths, words, bounds, numbers = inputs(found)
        edges = np.cumsum([0] + [len(p) for p in paths])
        flat = np.concatenate(paths)
        x = np.concatenate(
            [
                sums(self.weights["path"][flat], edges) / np.diff(edges)[:, None] ** 0.5,
                sums(self.weights["word"][words], bounds) / np.maximum(np.diff(bounds), 1)[:, None],
                numbers,
            ],
            1,
        )
        return x, (flat, edges, words, bounds)

    def run(self, x: np.ndarray, side: str, training: bool) -> tuple[np.ndarray, list]:
        """Hidden states over (time, row, input); the backward side reads a reversed sequence. What
        back-propagation needs of each step is kept in training alone."""
        wh, h, c = self.weights[f"h{side}"], np.zeros((x.shape[1], HIDDEN)), np.zeros((x.shape[1], HIDDEN))
        drive = x @ self.weights[f"x{side}"] + self.weights[f"c{side}"]
        out, kept = np.empty((*x.shape[:2], HIDDEN)), []
        for t in range(len(x)):
            z = drive[t] + h @ wh
            gates = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            before = c
            c = f * c + i * g
            s = np.tanh(c)
            if training:
                kept.append((h, before, i, f, o, g, s))
            h = o * s
            out[t] = h
        return out, kept

    def back(self, x: np.ndarray, side: str, down: np.ndarray, kept: list, grads: dict) -> np.ndarray:
        wx, wh = self.weights[f"x{side}"], self.weights[f"h{side}"]
        dh, dc = np.zeros((x.shape[1], HIDDEN)), np.zeros((x.shape[1], HIDDEN))
        dx = np.empty_like(x)
        for t in range(len(x) - 1, -1, -1):
            h, before, i, f, o, g, s = kept[t]
            dh = dh + down[t]
            dc = dc + dh * o * (1 - s * s)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * s * o * (1 - o), dc * i * (1 - g * g)], 1)
            grads[f"x{side}"] += x[t].T @ dz
            grads[f"h{side}"] += h.T @ dz
            grads[f"c{side}"] += dz.sum(0)
            dx[t] = dz @ wx.T
            dh, dc = dz @ wh.T, dc * f
        return dx

    @staticmethod
    def lay(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each block stands in a (time, row) matrix, forwards and backwards."""
        row = np.repeat(np.arange(len(lengths)), lengths)
        time = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        return np.stack([time, row]), np.stack([lengths[row] - 1 - time, row])

    def logits(self, found: list[Block], lengths: np.ndarray, training: bool = False):
        x, kept = self.embed(found)
        states, cells, laid = [], [], []
        for side, (time, row) in zip("fb", self.lay(lengths)):
            m = np.zeros((int(lengths.max()), len(lengths), x.shape[1]))
            m[time, row] = x
            out, k = self.run(m, side, training)
            states.append(out[time, row])
            cells.append((m, k, time, row))
        top = np.concatenate([*states, x], 1)
        return (top @ self.weights["out"])[:, 0] + self.weights["bias"][0], top, x, kept, cells

    def main_blocks(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page, which of its blocks are main text. Pages of like length go together."""
        out = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            batch, total = [], 0
            while at < len(order) and (not batch or (len(batch) < 256 and total + len(pages[order[at]]) < 20_000)):
                batch.append(order[at])
                total += len(pages[order[at]])
                at += 1
            lengths = np.array([len(pages[i]) for i in batch])
            z = self.logits([b for i in batch for b in pages[i]], lengths)[0] > 0
            for i, part in zip(batch, np.split(z, np.cumsum(lengths)[:-1])):
                out[i] = part
        return out


#: fixed values: names that layouts use for the parts of a page
MAIN = ["article", "main", "div.content", "div.post", "div#main", "section.article", "div.entry-content", "div.story", "div.article-body", "td.text", "div", "section", "div.page main", "div.text"]
INSIDE = ["p", "p", "p", "p", "p", "h1", "h2", "h3", "blockquote", "ul li", "ol li", "div", "pre", "figure figcaption", "table tr td", "dl dd", "p b", "p em", "p span"]
OUTSIDE = {
    "menu": ["nav ul li a", "ul.menu li a", "div.nav a", "div#menu ul li a", "nav a", "div.breadcrumb a", "div.navigation ul li", "ol.breadcrumbs li a", "div.pagination a", "div.skip a"],
    "header": ["header div.logo", "header p", "div.header h1", "div#top p", "div.masthead", "header h1 a", "div.topbar span"],
    "footer": ["footer", "footer p", "div.footer p", "div#footer ul li a", "footer div.copyright", "div.legal", "footer ul li"],
    "side": ["aside p", "aside ul li a", "div.sidebar p", "div.widget li a", "div#sidebar h3", "div.related ul li a", "div.recommended h3", "aside h2", "section.related p", "div.tags a", "div.author-bio p", "div.meta span", "div.byline"],
    "ad": ["div.ad", "div.ads p", "div.advert", "div.banner", "div.sponsored p", "div.promo a", "aside.ad p", "div#ad", "div.advertisement", "section.sponsor p", "p.ad", "ins.adsbygoogle"],
    "notice": ["div.cookie p", "div.cookie-notice", "div.notice p", "div.consent p", "div.alert", "div#cookies", "div.gdpr p", "div.popup p", "div.newsletter p", "div.subscribe p", "div.modal p", "p.notice", "div.paywall p", "aside.notice"],
    "form": ["form label", "form p", "form button", "div.search form label", "form div", "form fieldset legend", "div.login label", "button"],
    "comment": ["div.comments p", "section.comments p", "ul.comments li p", "div#comments div.comment p", "div.comment", "ol.commentlist li p", "div.comment-body p", "div.reply p", "section#comments h2", "div.disqus p", "article.comment p", "div.comments h3", "li.comment"],
    "share": ["div.share a", "div.social a", "ul.social li a", "div.sharing span"],
}


def layouts(n: int, seed: int) -> list[tuple[list[Block], np.ndarray]]:
    """Generated pages: blocks with paths and invented words, and which of them are main text."""
    rng = np.random.default_rng(seed)
    pick = lambda options: options[int(rng.integers(len(options)))]
    letters = list("etaoinshrdlucmfäéñçöü")
    vocabulary = ["".join(rng.choice(letters, int(rng.integers(2, 10)))) for _ in range(3000)]

    def words(low: int, high: int, sentences: bool) -> str:
        count = int(rng.integers(low, high + 1))
        out = [vocabulary[int(i)] for i in (rng.random(count) ** 2 * len(vocabulary))]
        if sentences:
            for i in range(0, count, int(rng.integers(5, 14))):
                out[i] = out[i].capitalize()
                if i:
                    out[i - 1] += "." if rng.random() < 0.8 else ","
            if rng.random() < 0.9:
                out[-1] += "."
        return " ".join(out)

    def path(names: str) -> tuple[int, ...]:
        found: list[int] = []
        for name in names.split():
            tag = re.match(r"[a-z0-9]+", name)[0]
            attributes = " ".join(f'{"class" if x[0] == "." else "id"}="{x[1:]}"' for x in re.findall(r"[.#][a-z-]+", name))
            found.extend(element(tag, attributes))
        return tuple(found)

    pages = []
    for _ in range(n):
        found: list[Block] = []
        label: list[bool] = []
        shell = pick(["html body", "html body", "html body div", "html body div#page", "body div.wrapper", "html body div.container", "body"])

        def part(kind: str, inside: str = "") -> None:
            where = path(f"{shell} {inside} {pick(OUTSIDE[kind])}")
            alike = kind in ("menu", "share", "form")
            for _ in range(int(rng.integers(1, 9 if alike else 4))):
                long = kind in ("ad", "notice", "footer", "side", "comment") and rng.random() < 0.6
                text = words(6, 70, True) if long else words(1, 12, rng.random() < 0.3)
                found.append(Block(where, text, len(text) if alike and rng.random() < 0.8 else 0))
                label.append(False)

        for kind in ("notice", "header", "menu", "ad", "side", "form"):
            if rng.random() < (0.75 if kind == "menu" else 0.35):
                part(kind)
        main = pick(MAIN)
        if rng.random() < 0.97:
            if rng.random() < 0.7:
                found.append(Block(path(f"{shell} {main} {pick(['h1', 'h1', 'header h1', 'h2'])}"), words(2, 14, rng.random() < 0.3)))
                label.append(True)
            for _ in range(int(rng.integers(1, 14))):
                inner = pick(INSIDE)
                short = inner in ("h1", "h2", "h3", "ul li", "ol li", "table tr td", "dl dd", "figure figcaption")
                text = words(1, 20, rng.random() < 0.5) if short or rng.random() < 0.15 else words(8, 160, True)
                found.append(Block(path(f"{shell} {main} {inner}"), text, int(len(text) * rng.random() * 0.3) if rng.random() < 0.2 else 0))
                label.append(True)
                if rng.random() < 0.06:
                    part(pick(["ad", "side", "form", "notice", "share"]), main)
            if rng.random() < 0.15:
                part(pick(["comment", "share", "side", "footer"]), main)
        for kind in ("share", "comment", "side", "ad", "form", "footer", "notice"):
            if rng.random() < (0.8 if kind == "footer" else 0.35):
                part(kind)
        if found:
            pages.append((found, np.array(label)))
    return pages


def train(pages: int = 1200, epochs: int = 5, batch: int = 24, rate: float = 0.01, seed: int = 3) -> Labeller:
    """Fit by back-propagation through time with Adam steps."""
    model = Labeller.new(seed)
    data = layouts(pages, seed)
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second = {k: np.zeros_like(v) for k, v in model.weights.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        for at in range(0, len(order), batch):
            part = [data[i] for i in order[at : at + batch].tolist()]
            found = [b for blocks_, _ in part for b in blocks_]
            target = np.concatenate([y for _, y in part]).astype(float)
            lengths = np.array([len(b) for b, _ in part])
            z, top, x, (flat, edges, words, bounds), cells = model.logits(found, lengths, training=True)
            grads = {k: np.zeros_like(v) for k, v in model.weights.items()}
            error = (1 / (1 + np.exp(-z)) - target) / len(z)
            grads["out"] = top.T @ error[:, None]
            grads["bias"] = np.array([error.sum()])
            down = error[:, None] @ model.weights["out"].T
            dx = down[:, 2 * HIDDEN :].copy()
            for n, (side, (m, kept, time, row)) in enumerate(zip("fb", cells)):
                d = np.zeros((*m.shape[:2], HIDDEN))
                d[time, row] = down[:, n * HIDDEN : (n + 1) * HIDDEN]
                dx += model.back(m, side, d, kept, grads)[time, row]
            np.add.at(grads["path"], flat, np.repeat(dx[:, :WIDTH] / np.diff(edges)[:, None] ** 0.5, np.diff(edges), 0))
            np.add.at(grads["word"], words, np.repeat(dx[:, WIDTH : 2 * WIDTH] / np.maximum(np.diff(bounds), 1)[:, None], np.diff(bounds), 0))
            step += 1
            now = rate * (1 - epoch / epochs)
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                model.weights[k] -= now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


_trained: list[Labeller] = []


def labeller() -> Labeller:
    """The trained labeller, fitted once for each driver."""
    if not _trained:
        _trained.append(train())
    return _trained[0]


def main_text(pages: list[str], model: Labeller) -> list[str]:
    found = [blocks(p) for p in pages]
    return ["\n\n".join([b.text for b, keep in zip(page, kept) if keep]) for page, kept in zip(found, model.main_blocks(found))]


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """``page_id``, ``url``, ``text`` (main text, empty if none) and ``n_chars`` of every row.

    Null and empty html give an empty text; repeated rows give repeated rows; an empty table an
    empty result; other columns are not read. Pages are read whole, however long. An element that
    is never closed takes no more than itself from the article.
    """
    used = model or labeller()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bytekit.slices(batch, "html"):
                texts = main_text([h or "" for h in part.column("html").to_pylist()], used)
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
