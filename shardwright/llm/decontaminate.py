"""Operator 1: benchmark decontamination.

Seeds are word n-grams of the test items. One pass over the corpus counts in
how many texts each seed stands; every item keeps the rarer half of its
seeds (ties included), so an item that is leaked everywhere still has seeds.
A second pass looks the corpus n-grams up among these seeds; each hit fixes
an item and a diagonal, hits on near diagonals share one window of the text,
and Smith-Waterman alignment of the item's words with the window scores it:
edits, insertions and paraphrased words lower the score instead of hiding
the copy. Items of fewer than ``min_words`` words are sought by their whole
word sequence: an exact copy only is a leak of them.

The benchmark is taken in blocks of at most ``block_bytes`` of text; each
block goes to every task, so what is broadcast is bounded and a larger
benchmark costs more passes. The corpus is never shuffled: a text is aligned
in the task that reads it, and a hot passage or source is spread like its
rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import sketches, textops

MATCH, MISMATCH, GAP = 2, -1, -1


def align(items: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment of each row pair of word hashes: ``(score,
    end)``, ``end`` the window word after the last aligned one. 0 pads an
    item, 1 a window (they match nothing). Linear gaps, one row of the
    matrix at a time for the whole batch: a gap along the row is a running
    maximum of scores plus their distance."""
    n, width = windows.shape
    above = np.zeros((n, width + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    slope = np.arange(width + 1, dtype=np.int32) * -GAP
    row = np.zeros_like(above)
    for k in range(items.shape[1]):
        w = items[:, k:k + 1]
        step = np.where((windows == w) & (w != 0), MATCH, MISMATCH)
        row[:, 1:] = np.maximum(above[:, :-1] + step, above[:, 1:] + GAP)
        np.maximum(row, 0, out=row)
        row[:, 0] = 0
        row = np.maximum.accumulate(row + slope, axis=1) - slope
        top = row.argmax(axis=1)
        val = row[np.arange(n), top]
        better = val > best
        best[better], end[better] = val[better], top[better]
        above, row = row, above
    return best, end


class Items:
    """One block of test items: word hashes, seeds and their places."""

    def __init__(self, rows: list[tuple], n: int, min_words: int):
        texts: dict[str, list] = {}
        for item, text in rows:
            texts.setdefault(text or "", []).append(item)
        col = pa.array(list(texts), pa.large_string())
        offs, data = textops.utf8(col)
        doc, _, _, h = textops.words(data[offs[0]:offs[-1]], offs - offs[0], textops.byte_class("alnum"), textops.ascii_fold())
        h = np.where(h < 2, np.uint64(2), h)
        count = np.bincount(doc, minlength=len(texts))
        self.keep = count >= min_words
        self.ids = list(texts.values())
        self.words = np.split(h, np.cumsum(count)[:-1]) if len(texts) else []
        self.short = []  # (words, sorted hashes of whole items, items)
        for k in np.unique(count[(count > 0) & ~self.keep]).tolist():
            own = count[doc] == k
            d, _, g = textops.ngrams(doc[own], h[own], k, len(texts), whole_short=False)
            o = np.argsort(g, kind="stable")
            self.short.append((k, g[o], d[o]))
        d, pos, g = textops.ngrams(doc, h, n, len(texts))
        ok = self.keep[d]
        d, pos, g = d[ok], pos[ok], g[ok]
        o = np.argsort(g, kind="stable")
        self.seed, first = np.unique(g[o], return_index=True)
        self.item, self.pos = d[o], pos[o]
        self.first = np.append(first, len(g))

    def rare(self, df: np.ndarray) -> "Items":
        """Keeps the seeds in the rarer half of some item, ties included."""
        per = np.repeat(df, np.diff(self.first))
        o = np.lexsort((per, self.item))
        item, cnt = self.item[o], per[o]
        start = np.searchsorted(item, np.arange(len(self.words)))
        stop = np.searchsorted(item, np.arange(len(self.words)), "right")
        mid = np.where(stop > start, np.minimum(start + np.maximum((stop - start + 1) // 2, 1) - 1, len(item) - 1), 0)
        limit = cnt[mid] if len(cnt) else np.zeros(len(self.words), np.int64)
        ok = per <= limit[self.item] if len(per) else np.zeros(0, bool)
        which = np.repeat(np.arange(len(self.seed)), np.diff(self.first))[ok]
        self.item, self.pos = self.item[ok], self.pos[ok]
        has = np.unique(which)
        self.seed = self.seed[has]
        self.first = np.append(np.searchsorted(which, has), len(which))
        return self


def _texts(batch_col, items: Items, n: int):
    """Per block: ``(a, doc of each word, words, hits (place, seed))``."""
    offs, data = textops.utf8(batch_col)
    for a, b in textops.blocks(offs):
        doc, _, _, h = textops.words(data[offs[a]:offs[b]], offs[a:b + 1] - offs[a], textops.byte_class("alnum"), textops.ascii_fold())
        h = np.where(h < 2, np.uint64(2), h)
        d, pos, g = textops.ngrams(doc, h, n, b - a, whole_short=False)
        if len(items.seed):
            at = np.minimum(np.searchsorted(items.seed, g), len(items.seed) - 1)
            hit = np.flatnonzero(items.seed[at] == g)
        else:
            at, hit = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield a, b, doc, h, d[hit], pos[hit], at[hit]


def _exact(items: Items, doc: np.ndarray, h: np.ndarray, n_docs: int):
    """``(doc, item, position, words)`` of the first exact copy of each short
    item in each text."""
    for k, grams, item in items.short:
        d, pos, g = textops.ngrams(doc, h, k, n_docs, whole_short=False)
        lo, hi = np.searchsorted(grams, g), np.searchsorted(grams, g, "right")
        hit = np.flatnonzero(hi > lo)
        _, first = np.unique(np.stack((d[hit], lo[hit])), axis=1, return_index=True)
        for j in hit[first].tolist():
            for i in item[lo[j]:hi[j]].tolist():
                yield int(d[j]), i, int(pos[j]), k


def _seed_counts(base: DataFrame, shared, n: int) -> DataFrame:
    def run(batches):
        items = shared.value
        total = np.zeros(len(items.seed), np.int64)
        for batch in batches:
            for _, b, _, _, d, _, s in _texts(batch.column(0), items, n):
                pair = np.unique(d * max(len(items.seed), 1) + s)
                np.add.at(total, pair % max(len(items.seed), 1), 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["seed", "df"])

    return base.select("text").mapInArrow(run, "seed bigint, df bigint").groupBy("seed").agg(F.sum("df").alias("df"))


def _best(cands, items: Items, h, start, stop, batch: int):
    """Scores candidate windows ``(doc, item, first diagonal)``."""
    out = []
    sizes = np.array([len(items.words[i]) for i in cands[:, 1]])
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        m = int(sizes[order[at]])
        some = order[at:at + max(1, min(batch, (1 << 21) // max(1, 4 * m)))]
        at += len(some)
        m = int(sizes[some].max())
        it = np.zeros((len(some), m), np.uint64)
        lo = np.empty(len(some), np.int64)
        hi = np.empty(len(some), np.int64)
        for r, c in enumerate(some):
            doc, item, block = cands[c]
            w = items.words[item]
            it[r, :len(w)] = w
            slack = max(4, len(w) // 3)
            lo[r] = max(start[doc], start[doc] + block * len(w) - slack)
            hi[r] = min(stop[doc], start[doc] + (block + 2) * len(w) + slack)
        width = int((hi - lo).max())
        col = lo[:, None] + np.arange(width)
        win = np.where(col < hi[:, None], h[np.minimum(col, len(h) - 1)], np.uint64(1))
        score, end = align(it, win)
        out += [(int(c), int(s), int(l + e), int(l), int(x)) for c, s, l, e, x in zip(some, score, lo, end, hi)]
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text: str = "text", n: int = 3, min_score: float = 0.4,
               min_words: int = 8, block_bytes: int = 4 << 20) -> DataFrame:
    """One row per text and test item it leaks: ``id_col, item_col, score,
    first_word, end_word`` (the aligned words of the text; the best window).

    ``score`` is the alignment score over that of an exact copy (match 2,
    mismatch and gap -1); a leak has ``min_score`` at least. Words are runs
    of ASCII letters, digits and non-ASCII characters, A-Z lower-cased.
    An item of fewer than ``min_words`` words leaks by an exact copy (score
    1) only; one of a word or two is thus found in every text that says it.
    Null items and items without words leak nowhere; items of equal text are
    each reported. Null and empty texts leak nothing. Null or repeated ids
    are reported as they are. Ties between windows go to the first. Other
    columns are ignored. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    textops.bounded_batches(spark)
    base = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"))
    bench = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).cast("string").alias("text")).filter("text IS NOT NULL")
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(size) // block_bytes))
    parts = []
    for k in range(blocks):  # each block's text is about block_bytes
        rows = [(r.item, r.text) for r in bench.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).collect()]
        parts.append(_leaks(spark, base, Items(rows, n, min_words), n, min_score, dict(base.dtypes)["id"], dict(bench.dtypes)["item"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "score", "first_word", "end_word")


def _leaks(spark, base, items: Items, n, min_score, id_type, item_type) -> DataFrame:
    arrow_item = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[item_type]
    schema = f"id {id_type}, item {item_type}, score double, first_word bigint, end_word bigint"
    first = spark.sparkContext.broadcast(items)
    df = np.zeros(len(items.seed), np.int64)
    for r in _seed_counts(base, first, n).collect():  # at most one row per seed of the block
        df[r.seed] = r.df
    shared = spark.sparkContext.broadcast(items.rare(df))

    def run(batches):
        items = shared.value
        for batch in batches:
            found = []
            for a, b, doc, h, d, pos, s in _texts(batch.column(0), items, n):
                for dd, it, at, k in _exact(items, doc, h, b - a):
                    for name in items.ids[it]:
                        found.append((a + dd, name, 1.0, at, at + k))
                if not len(d):
                    continue
                start = np.searchsorted(doc, np.arange(b - a))
                stop = np.searchsorted(doc, np.arange(b - a), "right")
                reps = np.diff(items.first)[s]
                k = np.repeat(items.first[s], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
                item, dd = items.item[k], np.repeat(d, reps)
                diag = np.repeat(pos, reps) - items.pos[k]
                size = np.array([len(w) for w in items.words])[item]
                cands = np.unique(np.stack((dd, item, np.floor_divide(diag, size)), axis=1), axis=0)
                best = {}
                for c, score, e, lo, hi in _best(cands, items, h, start, stop, 256):
                    x = score / (MATCH * len(items.words[cands[c][1]]))
                    key = (int(cands[c][0]), int(cands[c][1]))
                    if x >= min_score and (x, -e) > best.get(key, (0, 0))[:2]:
                        best[key] = (x, -e, lo)
                for (dd, it), (x, e, lo) in best.items():
                    w = items.words[it][::-1]
                    back = h[lo:-e][::-1]
                    _, length = align(w[None, :], back[None, :])  # the same alignment from its end
                    for name in items.ids[it]:
                        found.append((a + dd, name, x, int(-e - length[0] - start[dd]), int(-e - start[dd])))
            if found:
                cols = list(zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).take(pa.array(cols[0])), pa.array(cols[1], arrow_item), pa.array(cols[2], pa.float64()),
                     pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], names=["id", "item", "score", "first_word", "end_word"])

    return base.mapInArrow(run, schema)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """``docs`` without the rows whose text leaks an item; same columns. Rows
    that share a leaking row's id (null too) go with it."""
    leaks = materialize(docs.sparkSession, find_leaks(docs, benchmark, id_col, **how), "leaks")
    return sketches.without(docs, leaks.select(F.col(id_col).alias("id")).distinct(), [(F.col(id_col), "id")])
