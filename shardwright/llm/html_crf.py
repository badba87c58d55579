"""Operator 3: main text of web pages by a linear-chain conditional random
field over DOM leaf blocks.

Each block has indicator features: the tags above it, words of their class,
id and role, its own tag, its length, link share, signs and place. The chain
has two labels, article and other; it is trained on labelled pages by
gradient ascent of the conditional likelihood (forward-backward over all
pages at once) and decoded by Viterbi, batch by batch.

Training needs ``n_train`` pages (a documented bound) whose sentences come
from a bounded sample of the corpus; it runs once and the weights (64 KB)
are broadcast. Extraction is one narrow pass: a page is read and decoded in
one task, nothing is shuffled.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import html_blocks, html_training, sketches, textops

DIM = 1 << 12
_INDEX: dict[str, int] = {}


def _index(name: str) -> int:
    i = _INDEX.get(name)
    if i is None:
        if len(_INDEX) > 100_000:
            _INDEX.clear()
        i = _INDEX[name] = 1 + zlib.crc32(name.encode()) % (DIM - 1)
    return i


class Features:
    """Feature numbers of a page's blocks: ``flat``, cut at ``first``. A
    block has as many as its tags and class words give."""

    __slots__ = ("flat", "first")

    def __init__(self, flat: np.ndarray, first: np.ndarray):
        self.flat, self.first = flat, first

    def __len__(self) -> int:
        return len(self.first)


def page_features(blocks: list) -> Features:
    flat: list[int] = []
    first: list[int] = []
    last = len(blocks) - 1
    total = sum(len(b.text) for b in blocks)
    before = 0
    for k, b in enumerate(blocks):
        t = b.text
        words = t.count(" ") + 1
        size = min(8, words.bit_length())
        link = min(3, int(4 * b.linked / max(len(t), 1)))
        own, up = b.own, b.up
        f = ["bias", f"t:{own}", f"u:{up}", f"n:{size}", f"l:{link}", f"nl:{size}{link}", f"tn:{own}{size}",
             f"e:{t[-1] in '.!?:' }", f"tl:{own}{link}", f"c:{'©' in t}", f"at:{min(4, 5 * before // max(total, 1))}"]
        if k == 0 or k == last:
            f.append(f"edge:{k == 0}{k == last}")
        if b.hidden:
            f.append("hidden")
        f += [f"a:{x}" for x in b.above if x not in ("html", "body")]
        f += [f"k:{x}" for x in b.names]
        first.append(len(flat))
        flat += [_index(x) for x in f]
        before += len(t)
    return Features(np.array(flat, np.int32), np.array(first, np.int64))


# ---- the chain ----------------------------------------------------------
def _join(pages: list[Features]) -> tuple[Features, np.ndarray]:
    """All blocks of the pages in a row, and the pages' numbers of blocks."""
    at = np.cumsum([0] + [len(p.flat) for p in pages])
    return (Features(np.concatenate([p.flat for p in pages]), np.concatenate([p.first + a for p, a in zip(pages, at)])),
            np.array([len(p) for p in pages]))


def emissions(weights: np.ndarray, x: Features, inside: np.ndarray) -> np.ndarray:
    """Scores ``[page, block, label]``; ``inside`` marks the pages' blocks."""
    out = np.zeros((*inside.shape, 2), weights.dtype)
    out[inside] = np.add.reduceat(weights[x.flat], x.first, axis=0)
    return out


def _log_add(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def forward_backward(e: np.ndarray, trans: np.ndarray, sizes: np.ndarray):
    """Log likelihood normaliser, block marginals and expected transitions."""
    pages, n, _ = e.shape
    alpha, beta = np.zeros_like(e), np.zeros_like(e)
    alpha[:, 0] = e[:, 0]
    for t in range(1, n):
        alpha[:, t] = _log_add(alpha[:, t - 1][:, :, None] + trans, 1) + e[:, t]
    for t in range(n - 2, -1, -1):
        step = _log_add(trans + (beta[:, t + 1] + e[:, t + 1])[:, None, :], 2)
        beta[:, t] = np.where((t + 1 < sizes)[:, None], step, 0)
    z = _log_add(alpha[np.arange(pages), sizes - 1], 1)
    inside = np.arange(n) < sizes[:, None]
    marginal = np.exp(alpha + beta - z[:, None, None]) * inside[:, :, None]
    pair = np.exp(alpha[:, :-1, :, None] + trans + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None])
    return z, marginal, (pair * inside[:, 1:, None, None]).sum(axis=(0, 1))


def train(pages: list[Features], labels: list[np.ndarray], steps: int = 60, rate: float = 0.15, decay: float = 2e-3):
    """``(weights [DIM, 2], transitions [2, 2])`` by Adam on the regularised
    conditional log likelihood."""
    x, sizes = _join(pages)
    inside = np.arange(sizes.max()) < sizes[:, None]
    y = np.zeros(inside.shape, np.int64)
    for i, v in enumerate(labels):
        y[i, :len(v)] = v
    each = np.diff(np.append(x.first, len(x.flat)))
    gold = np.eye(2)[y] * inside[:, :, None]
    seen = np.zeros((2, 2))
    both = inside[:, 1:]
    np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), 1)
    w, tr = np.zeros((DIM, 2)), np.zeros((2, 2))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(tr), np.zeros_like(tr)]
    total = inside.sum()
    for step in range(1, steps + 1):
        e = emissions(w, x, inside)
        _, marginal, pairs = forward_backward(e, tr, sizes)
        diff = (gold - marginal) / total
        gw = np.stack([np.bincount(x.flat, np.repeat(diff[inside][:, k], each), DIM) for k in (0, 1)], axis=1) - decay * w / 50
        gw[0] = 0
        gt = (seen - pairs) / total
        for p, g, i in ((w, gw, 0), (tr, gt, 2)):
            state[i] = 0.9 * state[i] + 0.1 * g
            state[i + 1] = 0.99 * state[i + 1] + 0.01 * g * g
            p += rate * (state[i] / (1 - 0.9 ** step)) / (np.sqrt(state[i + 1] / (1 - 0.99 ** step)) + 1e-8)
    return w.astype(np.float32), tr


def viterbi(pages: list[Features], weights: np.ndarray, trans: np.ndarray) -> list[np.ndarray]:
    """Most likely labels of each page; pages of like length run together."""
    out: list = [np.zeros(0, np.int64)] * len(pages)
    order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        some = order[at:at + max(1, min(256, 20_000 // len(pages[order[min(at + 64, len(order) - 1)]])))]
        at += len(some)
        x, sizes = _join([pages[i] for i in some])
        n = int(sizes.max())
        e = emissions(weights, x, np.arange(n) < sizes[:, None])
        best, back = e[:, 0].astype(float), np.zeros((len(some), n, 2), np.int8)
        final = best.copy()
        for t in range(1, n):
            s = best[:, :, None] + trans
            back[:, t] = s.argmax(axis=1)
            best = s.max(axis=1) + e[:, t]
            live = t < sizes
            final[live] = best[live]
        for r, i in enumerate(some):
            y = np.empty(sizes[r], np.int64)
            y[-1] = final[r].argmax()
            for t in range(sizes[r] - 1, 0, -1):
                y[t - 1] = back[r, t, y[t]]
            out[i] = y
    return out


# ---- the operator -------------------------------------------------------
def labelled(sentences: list[str], n: int, seed: int):
    """Features and labels of ``n`` labelled pages."""
    xs, ys = [], []
    for page in html_training.labelled_pages(sentences, n, seed):
        marked = "".join(f"{m}" if y is None else _mark(m, y) for m, y in page)
        found = html_blocks.blocks("<html><body>" + marked + "</body></html>")
        y = np.array([int(b.text.startswith("\ue001") or "\ue001" in b.text) for b in found])
        for b in found:
            marks = b.text.count("\ue000") + b.text.count("\ue001")
            b.text = b.text.replace("\ue000", "").replace("\ue001", "") or "x"
            b.linked = max(0, b.linked - marks)
        if len(found):
            xs.append(page_features(found))
            ys.append(y)
    return xs, ys


_TAGS = re.compile(r"(<[^>]*>)")


def _mark(markup: str, label: int) -> str:
    """Puts a private mark of the label before each text of the markup."""
    sign = "\ue001" if label else "\ue000"
    return "".join(p if p.startswith("<") or not p.strip() else sign + p for p in _TAGS.split(markup))


def fit(docs: DataFrame, text_col: str = "text", n_train: int = 600, n_docs: int = 200, max_chars: int = 20_000, seed: int = 5):
    """Weights from ``n_train`` labelled pages filled with sentences of
    ``n_docs`` different texts at most (smallest text hashes; texts of more
    than ``max_chars`` characters are not drawn, which bounds the sample)."""
    texts = docs.select(F.col(text_col).cast("string").alias("t")).filter(F.length("t").between(21, max_chars)).withColumn("h", F.xxhash64("t"))
    bound = sketches.hash_bound(texts.agg(F.approx_count_distinct("h")).first()[0] * 9 // 10, n_docs)  # 5 % error: rather too many than too few
    few = texts.filter(F.col("h").cast("double") <= bound).groupBy("h").agg(F.first("t").alias("t"))
    rows = few.orderBy("h").limit(n_docs).collect()
    sentences = [s.strip() for r in rows for s in re.split(r"(?<=[.!?])\s+|\n+", r.t) if len(s) > 3] or ["One plain sentence.", "Another one follows here."]
    return train(*labelled(sentences, n_train, seed))


def extract(pages: DataFrame, model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: ``id_col, url_col, text, n_chars``.

    Blocks labelled article, in page order, joined by a line feed; null or
    empty html and a page without an article give the empty text. Scripts,
    styles, templates, form fields and the head never hold blocks. Repeated
    rows are each reported. Other columns are ignored. An empty table gives
    an empty result.
    """
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    textops.bounded_batches(base.sparkSession)
    shared = base.sparkSession.sparkContext.broadcast(model)
    kinds = dict(base.dtypes)

    def run(batches):
        weights, trans = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                found = [html_blocks.blocks(h) if h else [] for h in part.column(2).to_pylist()]
                labels = viterbi([page_features(f) for f in found], weights, trans)
                texts = ["\n".join(b.text for b, y in zip(f, lab) if y) for f, lab in zip(found, labels)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                                 names=["id", "url", "text", "n_chars"])

    out = base.mapInArrow(run, f"id {kinds['id']}, url {kinds['url']}, text string, n_chars bigint")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
