"""HTML extraction with a recurrent block labeller.

A page is read as the sequence of its text blocks. Each block is described by hashed vectors of its
tag path (tags, classes, ids, roles) and of its words, and a few figures. A bidirectional LSTM in
numpy reads the whole sequence and labels each block as main text or not, so that the context of the
whole page counts. It is trained on a bounded sample of pages: where a page marks its article with
semantic tags, its blocks are the examples; some of them are shown with other containers and
without these tags, so that the labels are learnt from more than one hint.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_PAGES = 300
PATH_BITS, WORD_BITS = 7, 5
HIDDEN = 16
#: Pages that are labelled at once, and blocks of them with those that fill up shorter pages.
CHUNK_PAGES, CHUNK_BLOCKS = 256, 1 << 16

RAW = "script|style|noscript|template|textarea|title|svg|iframe|select"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<svg\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*/>"
    rf"|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.DOTALL | re.IGNORECASE,
)
HINT = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
HINT_WORD = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Opening one of these ends an open one of the same kind.
SELF_CLOSING = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
    "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
}
#: Blocks close an open paragraph.
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main nav ol p pre section table ul".split()
)
#: What the examples are taken from: containers that hold the article, and what never is part of it.
ARTICLE = frozenset({"article", "main"})
OTHER = frozenset(
    "nav header footer aside form button label menu dialog head ad ads advert advertisement banner "
    "promo sponsor sponsored cookie cookies consent notice notices alert comment comments reply "
    "replies respond discussion sidebar navigation navbar breadcrumb breadcrumbs related share "
    "sharing social newsletter subscribe signup popup modal pagination".split()
)
SHOWN_AS = (
    "nav header footer aside form menu div.ad div.advert div.banner div.sponsored div.cookie "
    "div.notice div.comments section.comments ol.comment div.sidebar ul.menu div.related "
    "div.share div.newsletter div.breadcrumbs"
).split()


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: float


def hints(tag: str, attributes: str) -> tuple[str, ...]:
    words: list[str] = []
    for value in HINT.findall(attributes):
        words += HINT_WORD.findall(value.lower())
    return (tag, *("." + w for w in words))


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a page in page order. Tolerates missing end tags.

    White space inside a block becomes one space, character references are decoded, and text inside
    tags that hold no text (scripts, styles, titles, templates and the like) is left out.
    """
    page = page or ""
    stack: list[tuple[str, ...]] = []
    found: list[Block] = []
    parts: list[str] = []
    linked = total = 0
    path: tuple[str, ...] | None = None

    def close_block() -> None:
        nonlocal linked, total, path
        text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            found.append(Block(path or (), text, linked / max(1, total)))
        parts.clear()
        linked = total = 0
        path = None

    def add(text: str) -> None:
        nonlocal linked, total, path
        parts.append(text)
        if size := len(text.strip()):
            if path is None:
                path = tuple(w for level in stack for w in level)
            total += size
            if any(level[0] == "a" for level in stack):
                linked += size

    at = 0
    for token in TOKEN.finditer(page):
        if token.start() > at:
            add(page[at : token.start()])
        at = token.end()
        tag = (token[3] or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            close_block()
        elif tag == "br":
            parts.append(" ")
        if token[2]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    del stack[depth:]
                    break
            continue
        ends = SELF_CLOSING.get(tag, frozenset())
        if tag in CLOSES_P:
            ends = ends | {"p"}
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth][0] in ends:
                del stack[depth:]
                break
            if stack[depth][0] not in INLINE:
                break
        if tag not in VOID and not token[4].endswith("/"):
            stack.append(hints(tag, token[4]))
    if at < len(page):
        add(page[at:])
    close_block()
    return found


def path_row(path: tuple[str, ...]) -> np.ndarray:
    row = np.zeros(1 << PATH_BITS, dtype=np.float32)
    row[[zlib.crc32(word.encode()) & ((1 << PATH_BITS) - 1) for word in path]] = 1
    return row


def vectors(page: list[Block]) -> np.ndarray:
    """One row for each block: hashed path, hashed words, length, link share and place."""
    n, width = len(page), 1 << WORD_BITS
    words = [block.text.encode("utf-8", "replace").split() for block in page]
    count = np.array([len(w) for w in words], dtype=np.float32)
    hashed = [zlib.crc32(w) & (width - 1) for block in words for w in block]
    owner = np.repeat(np.arange(n) * width, count.astype(np.int64))
    bags = np.bincount(owner + np.array(hashed, dtype=np.int64), minlength=n * width)
    rest = np.column_stack(
        [
            np.log1p([len(block.text) for block in page]) / 6,
            np.log1p(count) / 5,
            [block.linked for block in page],
            np.arange(n) / max(1, n - 1),
            [block.text[-1] in ".!?" for block in page],
        ]
    )
    rows = {path: path_row(path) for path in {block.path for block in page}}
    return np.hstack(
        [
            np.stack([rows[block.path] for block in page]),
            bags.reshape(n, width) / np.maximum(count, 1)[:, None],
            rest,
        ]
    ).astype(np.float32)


@dataclass
class Network:
    """A layer in each direction: input, recurrent and bias weights; then the output weights."""

    inputs: list[np.ndarray]
    recurrent: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    shift: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [*self.inputs, *self.recurrent, *self.bias, self.out, self.shift]

    @classmethod
    def start(cls, width: int, hidden: int = HIDDEN) -> Network:
        rng = np.random.default_rng(3)
        new = lambda a, b: (rng.standard_normal((a, b)) * 0.3 / np.sqrt(hidden)).astype(np.float32)
        bias = np.zeros(4 * hidden, dtype=np.float32)
        bias[hidden : 2 * hidden] = 1  # remember at first
        return cls(
            [new(width, 4 * hidden) for _ in range(2)],
            [new(hidden, 4 * hidden) for _ in range(2)],
            [bias.copy(), bias.copy()],
            new(2 * hidden, 1)[:, 0],
            np.zeros(1, dtype=np.float32),
        )


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(time, page, feature) and (time, page) of whether there is a block."""
    longest = max(len(p) for p in pages)
    x = np.zeros((longest, len(pages), pages[0].shape[1]), dtype=np.float32)
    there = np.zeros((longest, len(pages)), dtype=bool)
    for i, page in enumerate(pages):
        x[: len(page), i], there[: len(page), i] = page, True
    return x, there


def layer(
    net: Network, d: int, x: np.ndarray, there: np.ndarray, keep: bool = True
) -> tuple[np.ndarray, list]:
    """States of one direction (1: from the end) and, if asked for, what the backward pass needs."""
    steps, pages, _ = x.shape
    size = len(net.recurrent[d])
    gates_in = x @ net.inputs[d] + net.bias[d]
    h, c = np.zeros((pages, size), np.float32), np.zeros((pages, size), np.float32)
    states, kept = np.zeros((steps, pages, size), np.float32), []
    for t in range(steps)[:: -1 if d else 1]:
        z = gates_in[t] + h @ net.recurrent[d]
        i, f, o = (sigmoid(z[:, k * size : (k + 1) * size]) for k in range(3))
        g = np.tanh(z[:, 3 * size :])
        on = there[t][:, None]
        c_new = np.where(on, f * c + i * g, c)
        wave = np.tanh(c_new)
        h_new = np.where(on, o * wave, h)
        if keep:
            kept.append((t, h, c, i, f, o, g, wave, on))
        h, c = h_new, c_new
        states[t] = h
    return states, kept


def scores(net: Network, x: np.ndarray, there: np.ndarray) -> np.ndarray:
    both = np.concatenate([layer(net, d, x, there, keep=False)[0] for d in range(2)], axis=2)
    return sigmoid(both @ net.out + net.shift)


def gradients(net: Network, x: np.ndarray, there: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    runs = [layer(net, d, x, there) for d in range(2)]
    both = np.concatenate([s for s, _ in runs], axis=2)
    p = sigmoid(both @ net.out + net.shift)
    off = np.where(there, p - y, 0).astype(np.float32) / there.sum()
    d_out = np.einsum("tp,tph->h", off, both)
    inputs, recurrent, bias = [], [], []
    for d, (_, kept) in enumerate(runs):
        size = len(net.recurrent[d])
        d_states = off[:, :, None] * net.out[d * size : (d + 1) * size]
        dh, dc = np.zeros_like(d_states[0]), np.zeros_like(d_states[0])
        dz_all = np.zeros((*x.shape[:2], 4 * size), np.float32)
        d_recurrent = np.zeros_like(net.recurrent[d])
        for t, h, c, i, f, o, g, wave, on in reversed(kept):
            dh = dh + d_states[t]
            dc_new = dc + np.where(on, dh * o * (1 - wave**2), 0)
            dz = np.hstack(
                [
                    dc_new * g * i * (1 - i),
                    dc_new * c * f * (1 - f),
                    dh * wave * o * (1 - o),
                    dc_new * i * (1 - g**2),
                ]
            )
            dz = np.where(on, dz, 0)
            dz_all[t] = dz
            d_recurrent += h.T @ dz
            dh = np.where(on, dz @ net.recurrent[d].T, dh)
            dc = np.where(on, dc_new * f, dc)
        flat = dz_all.reshape(-1, 4 * size)
        inputs.append(x.reshape(-1, x.shape[2]).T @ flat)
        recurrent.append(d_recurrent)
        bias.append(flat.sum(axis=0))
    return [*inputs, *recurrent, *bias, d_out, np.array([off.sum()], np.float32)]


def example(page: list[Block], rng: np.random.Generator) -> tuple[list[Block], np.ndarray] | None:
    """A page whose article is marked, with its labels; some are disguised."""
    wanted = np.array(
        [
            bool(ARTICLE.intersection(b.path))
            and not OTHER.intersection(w.lstrip(".") for w in b.path)
            for b in page
        ]
    )
    if not wanted.any():
        return None
    kind = rng.random()
    if kind < 0.5:
        return page, wanted.astype(np.float32)
    shown = []
    name = str(rng.choice(SHOWN_AS))
    for i, b in enumerate(page):
        path = b.path
        if wanted[i] and kind > 0.75:  # the article without its mark
            path = tuple("div" if w in ARTICLE else w for w in path)
        if not wanted[i]:
            if i == 0 or wanted[i - 1] or rng.random() < 0.1:
                name = str(rng.choice(SHOWN_AS))
            tail = path[2:] if path[:2] == ("html", "body") else path
            around = ("article",) if rng.random() < 0.15 else ()
            tag, _, word = name.partition(".")
            path = ("html", "body", *around, tag, *(("." + word,) if word else ()), *tail[-2:])
            if around:
                path = tuple(w for w in path if w in around or w not in ARTICLE)
        shown.append(Block(path, b.text, b.linked))
    return shown, wanted.astype(np.float32)


def train(pages: list[list[Block]], epochs: int = 20, rate: float = 0.02) -> Network | None:
    """Learn from the pages whose article is marked; None if there is none."""
    rng = np.random.default_rng(7)
    cases = [c for page in pages if (c := example(page, rng)) is not None]
    if not cases:
        return None
    cases.sort(key=lambda c: len(c[0]))
    batches = []
    for start in range(0, len(cases), 32):
        part = cases[start : start + 32]
        x, there = padded([vectors(p) for p, _ in part])
        y = np.zeros(there.shape, np.float32)
        for i, (_, label) in enumerate(part):
            y[: len(label), i] = label
        batches.append((x, there, y))
    net = Network.start(batches[0][0].shape[2])
    slope = [np.zeros_like(w) for w in net.parts()]
    square = [np.zeros_like(w) for w in net.parts()]
    step = 0
    for _ in range(epochs):
        for b in rng.permutation(len(batches)):
            step += 1
            for w, g, m, v in zip(net.parts(), gradients(net, *batches[b]), slope, square, strict=True):
                g = np.clip(g, -1, 1)
                m += 0.1 * (g - m)
                v += 0.01 * (g**2 - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def main_text(pages: list[str | None], net: Network | None) -> list[str]:
    read = [blocks(page) for page in pages]
    out = [""] * len(pages)
    order = sorted((i for i in range(len(read)) if read[i]), key=lambda i: len(read[i]))
    if net is None:
        return ["\n\n".join(b.text for b in page) for page in read]
    for part in chunks(order, [len(page) for page in read]):
        good = scores(net, *padded([vectors(read[i]) for i in part])) >= 0.5
        for column, i in enumerate(part):
            out[i] = "\n\n".join(b.text for t, b in enumerate(read[i]) if good[t, column])
    return out


def chunks(order: list[int], sizes: list[int]) -> Iterator[list[int]]:
    """Runs of pages, short ones first, that stay within the bounds when all are as long as the
    longest; a page beyond them is alone."""
    part: list[int] = []
    for i in order:
        if part and (len(part) == CHUNK_PAGES or (len(part) + 1) * sizes[i] > CHUNK_BLOCKS):
            yield part
            part = []
        part.append(i)
    if part:
        yield part


def fit(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> Network | None:
    """Train on pages that mark an article, those with the smallest id hashes of the whole table; the
    driver holds this bounded sample."""
    marked = F.col("html").rlike(r"(?i)<(article|main)\b")
    ids = pages.filter(marked).select("page_id").filter("page_id is not null").distinct()
    ids = ids.orderBy(F.xxhash64("page_id"), "page_id").limit(sample_pages)
    sample = (
        pages.select("page_id", "html")
        .filter(marked)
        .join(F.broadcast(ids), "page_id")
        .groupBy("page_id")
        .agg(F.min("html").alias("html"))
        .toPandas()
        .sort_values("page_id")
    )
    return train([blocks(page) for page in sample["html"]])


def extract_main_text(pages: DataFrame, net: Network | None = None) -> DataFrame:
    """page_id, url, text, n_chars: the main text of every page.

    Args:
        pages: page_id, url, html; other columns are ignored.
        net: a trained labeller; by default one is trained on a sample of these pages.

    Blocks are joined in page order by two line feeds. A null or empty page, and one without main
    text, has an empty text. Each repeated row has a row of its own. If no page of the table marks
    an article there is nothing to learn from, and all blocks are kept. A very long page is labelled
    alone, within its row. An empty table gives an empty result.
    """
    learned = net or fit(pages)

    @F.pandas_udf("string")
    def text_of(batch: pd.Series) -> pd.Series:
        return pd.Series(main_text(list(batch), learned))

    return pages.select("page_id", "url", text_of("html").alias("text")).withColumn(
        "n_chars", F.length("text").cast("long")
    )


def evaluate(pages: Iterator[list[Block]], net: Network) -> tuple[int, int]:
    """Blocks labelled as their marks say, and all blocks, of pages that mark their article."""
    right = total = 0
    rng = np.random.default_rng(11)
    for page in pages:
        if case := example(page, rng):
            p = scores(net, *padded([vectors(case[0])]))[:, 0] >= 0.5
            right += int((p == (case[1] > 0.5)).sum())
            total += len(p)
    return right, total
