"""Main text of HTML pages: a recurrent labeller decides for each leaf block, seeing the whole page.

A page becomes its sequence of leaf blocks. A block is described by its tag path (tags, class and id words of all
elements around it, hashed), its words (hashed) and a few measures. A bidirectional LSTM in numpy reads the
sequence and gives each block a probability of being article text, so a block is judged by everything before and
after it. Blocks above one half are joined.

Training needs no labelled pages: a bounded sample (``SAMPLE`` pages, smallest hash of the id, each
below ``SAMPLE_CHARS``, of which the first ``SAMPLE_BLOCKS`` blocks) is labelled by what its markup says (``article`` against ``nav``, ``footer`` and so on),
then rebuilt in other layouts: other wrappers and notices, forms, sidebars, comments put in at random places.

Defined cases: null and empty pages have an empty text, as do pages without article blocks; a page of any length is read whole; broken markup
(unclosed or cut tags, stray end tags) never fails; equal pages get equal texts; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE, SAMPLE_CHARS, SAMPLE_BLOCKS = 300, 50_000, 400
PATH_DIM, WORD_DIM, HIDDEN, EPOCHS = 96, 16, 16, 60
IN = PATH_DIM + WORD_DIM + 4

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BREAKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-z][a-z0-9:-]*)([^>]*)>"
    r"|<[!?/][^>]*(?:>|\Z)|<[a-z][^>]*\Z", re.I | re.S)
#: Elements without article text that end as others do: by a slash, by their end tag, or, without one, not at all.
SKIPPED = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in ("noscript", "template", "svg", "object")}
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[a-z]+|[0-9]+")

# words of tags, classes and ids that tell what is not an article
OTHER = frozenset(
    "nav menu navbar navigation breadcrumb breadcrumbs header masthead footer sidebar aside ad ads advert adverts advertisement banner sponsor sponsored "
    "promo cookie cookies consent notice notices alert popup modal overlay form login signup subscribe newsletter search comment comments "
    "respond reply replies discussion disqus share sharing social related recommended pagination pager widget toolbar copyright legal head "
    "title button select option dialog".split())
MAIN = frozenset("article main content post entry story".split())


class Block(NamedTuple):
    path: tuple[str, ...]
    text: str
    linked: int


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order: path words, text with single spaces, characters inside links."""
    found: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    pieces: list[str] = []
    linked, in_link = 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(pieces)).split()) if pieces else ""
        if text:
            found.append(Block(tuple(w for _, names in stack for w in names), text, linked))
        pieces.clear()
        linked = 0

    def pop(k: int) -> None:
        nonlocal in_link
        for tag, _ in stack[k:]:
            in_link -= tag == "a"
        del stack[k:]

    at, endless = 0, set()
    while m := MARKUP.search(page, at):
        if m.start() > at:
            pieces.append(page[at:m.start()])
            linked += (m.start() - at) * (in_link > 0)
        at = m.end()
        tag, closed = (m[3] or m[6] or "").lower(), (m[4] or m[7] or "").endswith("/")
        if not tag:
            continue
        if m[2] or m[5]:
            if tag in BREAKS:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop(k)
                    break
            continue
        if tag in SKIPPED and not closed and tag not in endless:
            end = SKIPPED[tag].search(page, at)
            if end:
                at = end.end()
                continue
            endless.add(tag)        # none follows: looked for once
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in BREAKS:
            flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p" or stack[k][0] in CLOSES.get(tag, ()):
                    pop(k)
                    break
                if stack[k][0] in BREAKS:
                    break
        if tag not in VOID and not closed:
            names = [tag]
            for a in NAMES.findall(m[4] or m[7] or ""):
                names += WORD.findall("".join(a).lower())
            stack.append((tag, tuple(names)))
            in_link += tag == "a"
    if at < len(page):
        pieces.append(page[at:])
    flush()
    return found


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = found = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORD_DIM
        return found


_buckets, _paths = _Buckets(), {}


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    found = _paths.get(path)
    if found is None:
        found = np.zeros(PATH_DIM, np.float32)
        for word in set(path):
            for seed in (1, 2):
                h = zlib.crc32(word.encode("utf-8", "surrogatepass"), seed)
                found[h % PATH_DIM] += 1 if h >> 16 & 1 else -1
        if len(_paths) > 50_000:
            _paths.clear()
        _paths[path] = found
    return found


def features(sequence: list[Block]) -> np.ndarray:
    out = np.zeros((len(sequence), IN), np.float32)
    for i, b in enumerate(sequence):
        words = b.text.split(" ")
        out[i, :PATH_DIM] = _path_vector(b.path)
        out[i, PATH_DIM:PATH_DIM + WORD_DIM] = np.bincount([_buckets[w] for w in words], minlength=WORD_DIM)
        out[i, PATH_DIM:PATH_DIM + WORD_DIM] /= len(words)
        out[i, -4:] = np.log1p(len(b.text)) / 5, b.linked / len(b.text), b.text.count(".") / len(words), i / len(sequence)
    return out


class Labeller(NamedTuple):
    """Weights of both directions: (input and state to gates, bias), and of the output."""
    forward: tuple[np.ndarray, np.ndarray]
    backward: tuple[np.ndarray, np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def probabilities(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(pages, blocks) for padded (pages, blocks, IN)."""
        one, _ = _run(x, *self.forward)
        two, _ = _run(_turned(x, lengths), *self.backward)
        h = np.concatenate([one, _turned(two, lengths)], axis=2)
        return 1 / (1 + np.exp(-(h @ self.out + self.bias)))


def _turned(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Every sequence reversed, its padding left at the end."""
    t = np.arange(x.shape[1])
    at = np.where(t < lengths[:, None], lengths[:, None] - 1 - t, t)
    return np.take_along_axis(x, at[:, :, None], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(x: np.ndarray, w: np.ndarray, b: np.ndarray, training: bool = False) -> tuple[np.ndarray, list]:
    """States of every step and, in training, what the gradients need of it."""
    n, steps, _ = x.shape
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    out, kept = np.zeros((n, steps, HIDDEN), np.float32), []
    drive = x @ w[:x.shape[2]] + b
    for t in range(steps):
        gates = drive[:, t] + h @ w[x.shape[2]:]
        i, f, o = (_sigmoid(gates[:, k * HIDDEN:(k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(gates[:, 3 * HIDDEN:])
        was_h, was_c = h, c
        c = f * c + i * g
        h = o * np.tanh(c)
        out[:, t] = h
        if training:
            kept.append((i, f, o, g, was_h, was_c, c))
    return out, kept


def _back(x: np.ndarray, w: np.ndarray, kept: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the weights and the bias of one direction."""
    dw, db = np.zeros_like(w), np.zeros(w.shape[1], np.float32)
    dh, dc = np.zeros_like(d_out[:, 0]), np.zeros_like(d_out[:, 0])
    for t in range(x.shape[1] - 1, -1, -1):
        i, f, o, g, was_h, was_c, c = kept[t]
        dh = dh + d_out[:, t]
        tc = np.tanh(c)
        dc = dc + dh * o * (1 - tc * tc)
        gates = np.concatenate([dc * g * i * (1 - i), dc * was_c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        dw[:x.shape[2]] += x[:, t].T @ gates
        dw[x.shape[2]:] += was_h.T @ gates
        db += gates.sum(0)
        dh, dc = gates @ w[x.shape[2]:].T, dc * f
    return dw, db


def padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(s) for s in sequences])
    x = np.zeros((len(sequences), max(1, lengths.max(initial=0)), IN), np.float32)
    for i, s in enumerate(sequences):
        x[i, :len(s)] = s
    return x, lengths


def train(sequences: list[tuple[list[Block], list[int]]], epochs: int = EPOCHS, rate: float = 0.01) -> Labeller:
    """Adam on mini-batches of pages, loss over all their blocks."""
    rng = np.random.default_rng(1)
    w = [rng.normal(0, 0.15, (IN + HIDDEN, 4 * HIDDEN)).astype(np.float32), np.zeros(4 * HIDDEN, np.float32),
         rng.normal(0, 0.15, (IN + HIDDEN, 4 * HIDDEN)).astype(np.float32), np.zeros(4 * HIDDEN, np.float32),
         rng.normal(0, 0.3, 2 * HIDDEN).astype(np.float32), np.zeros(1, np.float32)]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    data = sorted(((features(s), np.array(y, np.float32)) for s, y in sequences if s), key=lambda p: len(p[1]))
    groups = [data[i:i + 64] for i in range(0, len(data), 64)]
    step = 0
    for _ in range(epochs):
        for k in rng.permutation(len(groups)):
            x, lengths = padded([s for s, _ in groups[k]])
            y = np.zeros(x.shape[:2], np.float32)
            for i, (_, t) in enumerate(groups[k]):
                y[i, :len(t)] = t
            mask = np.arange(x.shape[1]) < lengths[:, None]
            turned = _turned(x, lengths)
            one, kept1 = _run(x, w[0], w[1], True)
            two, kept2 = _run(turned, w[2], w[3], True)
            h = np.concatenate([one, _turned(two, lengths)], axis=2)
            d = ((_sigmoid(h @ w[4] + w[5]) - y) * mask / mask.sum()).astype(np.float32)
            dh = d[:, :, None] * w[4]
            grads = [*_back(x, w[0], kept1, dh[:, :, :HIDDEN]), *_back(turned, w[2], kept2, _turned(dh[:, :, HIDDEN:], lengths)),
                     np.einsum("nt,nth->h", d, h), np.array([d.sum()], np.float32)]
            step += 1
            for i, g in enumerate(grads):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
                w[i] = (w[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return Labeller((w[0], w[1]), (w[2], w[3]), w[4], w[5])


def said_by_markup(sequence: list[Block]) -> list[int]:
    """1 for blocks inside an article element (or, on pages without one, in none of the other parts)."""
    framed = any(MAIN & set(b.path) for b in sequence)
    return [int(not OTHER & set(b.path) and (not framed or bool(MAIN & set(b.path)))) for b in sequence]


WRAPPERS = [("article",), ("main",), ("div", "content"), ("main", "div", "post"), ("div", "entry", "content"), ("section", "story"), ("div", "article", "body")]
PARTS = [
    (("nav", "ul", "li", "a"), True), (("div", "menu", "ul", "li", "a"), True), (("header", "div"), False), (("header", "p"), False), (("div", "breadcrumbs", "a"), True),
    (("aside", "p"), False), (("aside", "ul", "li", "a"), True), (("div", "sidebar", "p"), False), (("div", "sidebar", "ul", "li"), True), (("div", "ad"), False), (("div", "advert", "p"), False),
    (("div", "ads", "banner"), False), (("div", "cookie", "notice", "p"), False), (("div", "cookie", "banner"), False), (("div", "notice"), False), (("form", "label"), False),
    (("form", "p"), False), (("form", "div", "button"), False), (("section", "comments", "p"), False), (("div", "comments", "div", "comment", "p"), False), (("div", "comment"), False),
    (("ol", "comment", "list", "li", "p"), False), (("div", "related", "ul", "li", "a"), True), (("div", "share", "a"), True), (("div", "newsletter", "p"), False), (("div", "subscribe"), False),
    (("footer",), False), (("footer", "p"), False), (("div", "footer"), False), (("div", "popup", "p"), False), (("div", "sponsored", "p"), False), (("head", "title"), False),
]


def layouts(sequence: list[Block], labels: list[int], draw: random.Random) -> tuple[list[Block], list[int]]:
    """The page in another layout: another wrapper, other parts before, after and between the article's blocks."""
    wrapper, root = draw.choice(WRAPPERS), ("html", "body", *draw.choice([(), ("div",), ("div", "wrapper"), ("div", "page", "container")]))
    spare = [b.text for b in sequence] or ["more"]

    def parts(inside: bool) -> list[tuple[Block, int]]:
        out = []
        for _ in range(draw.choice([0, 0, 1, 2] if inside else [0, 1, 2, 3])):
            path, link = draw.choice(PARTS)
            around = (*root, *wrapper) if inside else root
            for _ in range(draw.choice([1, 1, 2, 4])):
                text = draw.choice(spare)
                text = " ".join(text.split(" ")[:draw.choice([1, 2, 5, 20, 60])])
                out.append((Block((*around, *path), text, len(text) if link else 0), 0))
        return out

    body = []
    for b, label in zip(sequence, labels):
        if label:
            tail = b.path[-1] if b.path and b.path[-1] in ("h1", "h2", "h3", "p", "li", "b", "td", "blockquote") else "p"
            inner = draw.choice([(tail,), (tail,), (tail,), ("div", tail), ("ul", "li"), ("blockquote", "p"), ("h2",), (tail, "b"), (tail, "a")])
            body.append((Block((*root, *wrapper, *inner), b.text, len(b.text) if inner[-1] == "a" else b.linked), 1))
    middle = draw.randrange(len(body) + 1)
    mixed = [*parts(False), *body[:middle], *(parts(True) if draw.random() < 0.3 else []), *body[middle:], *(parts(True) if draw.random() < 0.3 else []), *parts(False)]
    return [b for b, _ in mixed], [y for _, y in mixed]


def fit(pages: DataFrame, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS, sample_blocks: int = SAMPLE_BLOCKS) -> Labeller:
    """A labeller from at most ``sample`` pages; the driver holds ``sample`` x ``sample_chars`` at most."""
    rows = (pages.select(F.col("page_id").cast("long").alias("page_id"), "html").filter(F.length("html").between(1, sample_chars))
            .orderBy(F.xxhash64("page_id", F.lit(29)), "page_id", F.xxhash64("html")).limit(sample).collect())
    draw, found = random.Random(7), []
    for row in rows:
        seq = blocks(row["html"])[:sample_blocks]
        labels = said_by_markup(seq)
        found.append((seq, labels))
        found += [layouts(seq, labels, draw) for _ in range(3)]
    if not any(s for s, _ in found):
        found = [layouts([Block(("p",), "text of a page.", 0)] * 3, [1, 1, 1], draw) for _ in range(50)]
    return train(found)


def page_texts(pages: list[str], labeller: Labeller) -> list[str]:
    sequences = [blocks(p) for p in pages]
    texts = [""] * len(pages)
    order = sorted((i for i, s in enumerate(sequences) if s), key=lambda i: len(sequences[i]))
    while order:
        longest = len(sequences[order[-1]])
        take = [order.pop() for _ in range(min(len(order), max(1, 20_000 // longest)))]
        x, lengths = padded([features(sequences[i]) for i in take])
        for i, p in zip(take, labeller.probabilities(x, lengths)):
            texts[i] = "\n".join(b.text for b, q in zip(sequences[i], p) if q > 0.5)
    return texts


def extract(pages: DataFrame, labeller: Labeller) -> DataFrame:
    """Every page: page_id, url, text (the article's blocks, one a line; never null)."""
    shared = pages.sparkSession.sparkContext.broadcast(labeller)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(1, len(batch)), 500):
                part = batch.slice(at, 500)
                texts = page_texts([v.as_py() or "" for v in part.column("html")], shared.value)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(run, "page_id long, url string, text string")
