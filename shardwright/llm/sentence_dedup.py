"""Operator 2: substring dedup by sliding sentence spans.

A text is cut into sentences; every run of three consecutive sentences is
hashed, whatever its length. Passages of fewer sentences count too where they
are long: runs of two sentences with 25 words, single ones with 50.
Runs are joined over the whole corpus; the first occurrence of a run stays
and every sentence covered by a later one is removed.

Two passes: the first counts run hashes (folded per block, then by a grouped
sum) and leaves a bitmap of those seen twice; the second emits only runs in
the bitmap, finds the first occurrence of each by a grouped minimum, writes
it, and joins it back. A passage that stands in a third of all texts is one
row per task in the first shuffle. In the join, runs that hold at least a
``1 / HOT`` share of the rows (so at most ``HOT`` runs) are broadcast and
their rows stay where they are; only rows of the others are shuffled. Texts
move only if a sentence of theirs goes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import sketches, textops

SPAN = 3                        # sentences of a run, of any length
LONG = ((2, 25), (1, 50))       # (sentences, words at least) of shorter runs
HOT, HOT_ROWS = 100_000, 1000   # a hot run holds 1/HOT of all rows and HOT_ROWS at least
_U = np.uint64


def sentences(data: np.ndarray, offs: np.ndarray):
    """Sentences that hold a word: ``(doc, start, words, hash)``. One ends
    after ``.``, ``!`` or ``?`` before white space, at a line end and at the
    text's end; pieces without a word belong to the sentence before. The
    hash is over the words (letters and digits, A-Z lower-cased)."""
    n = len(data)
    doc, start, _, h = textops.words(data, offs, textops.byte_class("alnum"), textops.ascii_fold())
    if not len(doc):
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    space = ~textops.byte_class("nonspace")[data]
    stop = np.zeros(n + 1, np.int64)
    end = (data == 0x2E) | (data == 0x21) | (data == 0x3F)
    stop[1:n] = (end[:-1] & space[1:]) | (data[:-1] == 0x0A)
    part = np.cumsum(stop)[start]
    new = np.append(True, (part[1:] != part[:-1]) | (doc[1:] != doc[:-1]))
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(doc)))
    return doc[first], start[first], size, _spans(h, first, first + size)


def _spans(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the values ``h[a:b]`` in order, for each pair."""
    power, inverse = textops._powers(len(h))
    total = np.append(_U(0), np.cumsum(h * power[:len(h)], dtype=np.uint64))
    return textops.mix((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64))


def runs(doc: np.ndarray, size: np.ndarray, h: np.ndarray, n_docs: int, spans=((SPAN, 0), *LONG)):
    """``(doc, first sentence, sentences, hash)`` of every run; ``spans``
    holds (sentences, words at least)."""
    first = np.searchsorted(doc, np.arange(n_docs))
    words = np.append(0, np.cumsum(size))
    out = []
    for k, least in spans:
        if len(doc) < k:
            continue
        at = np.flatnonzero(doc[:len(doc) - k + 1] == doc[k - 1:])
        at = at[words[at + k] - words[at] >= least]
        out.append((doc[at], at - first[doc[at]], np.full(len(at), k), _spans(h, at, at + k) ^ _U(k)))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _blocks(column):
    offs, data = textops.utf8(column)
    for a, b in textops.blocks(offs):
        o = offs[a:b + 1] - offs[a]
        doc, start, size, h = sentences(data[offs[a]:offs[b]], o)
        yield a, b, o, doc, start, size, h


def find_spans(base: DataFrame, bitmap_bits: int = 25, span: int = SPAN, min_words: int = 0, long=LONG) -> DataFrame:
    """``(id, t, runs)`` of texts with removed sentences; ``runs`` holds
    (first sentence, sentences) pairs. ``t`` is the text's hash. Runs are of
    ``span`` sentences with ``min_words`` words (none asked by default), and
    the shorter ones of ``long``."""
    spark = base.sparkSession
    spans = ((span, min_words), *long)

    def count(batches):
        for batch in batches:
            for a, b, _, doc, _, size, h in _blocks(batch.column(0)):
                u, c = np.unique(runs(doc, size, h, b - a, spans)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(textops.signed(u)), pa.array(c)], names=["run", "n"])

    twice = base.select("text").mapInArrow(count, "run bigint, n bigint").groupBy("run").agg(F.sum("n").alias("n")).filter("n > 1")
    bitmap = sketches.share(spark, sketches.key_bitmap(twice, "run", bitmap_bits))
    kind = dict(base.dtypes)["id"]

    def emit(batches):
        for batch in batches:
            for a, b, _, doc, _, size, h in _blocks(batch.column(2)):
                d, s, k, r = runs(doc, size, h, b - a, spans)
                hit = np.flatnonzero(sketches.in_bitmap(bitmap.value, r))
                rows = pa.array(a + d[hit])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(s[hit], pa.int32()), pa.array(k[hit], pa.int32()),
                     pa.array(textops.signed(r[hit]))], names=["id", "t", "first", "size", "run"])

    rows = base.select("id", "t", "text").mapInArrow(emit, f"id {kind}, t bigint, first int, size int, run bigint")
    rows = materialize(spark, rows, "sentence-runs")
    place = F.struct(F.col("id").isNull().alias("x"), "id", "t", "first")
    origin = rows.groupBy("run").agg(F.min(place).alias("origin"), F.count("*").alias("n")).filter("n > 1")
    origin = materialize(spark, origin, "sentence-origins")
    n_rows = origin.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    is_hot = F.col("n") >= max(HOT_ROWS, -(-n_rows // HOT))
    hot = F.broadcast(origin.filter(is_hot).drop("n"))  # at most HOT rows
    cold = origin.filter(~is_hot).drop("n")
    told = rows.join(hot, "run").unionByName(rows.join(hot.select("run"), "run", "left_anti").join(cold, "run"))
    later = told.filter(~((F.col("id").eqNullSafe(F.col("origin.id"))) & (F.col("t") == F.col("origin.t")) & (F.col("first") == F.col("origin.first"))))
    return later.groupBy("id", "t").agg(F.collect_set(F.struct("first", "size")).alias("runs"))  # a text's own runs


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per input row: ``id_col, n_sentences, n_removed, text``.

    Occurrences are ordered by (id, text hash, sentence), null ids last; the
    first keeps its sentences. Rows that repeat an id and text share one
    decision. A text without words has no sentences and is unchanged; null
    text is empty text. A removed sentence goes with the white space behind
    it. Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    textops.bounded_batches(spark)
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    gone = materialize(spark, find_spans(base, **how), "sentence-gone")
    bitmap = sketches.share(spark, sketches.key_bitmap(gone.select(F.xxhash64("id", "t").alias("h")), "h"))
    kind = dict(base.dtypes)["id"]
    out = f"id {kind}, n_sentences bigint, n_removed bigint, text string"

    def whole(batches):  # texts that keep all; the others wait for their runs
        for batch in batches:
            m = sketches.in_bitmap(bitmap.value, batch.column(0).to_numpy(zero_copy_only=False))
            n = np.zeros(batch.num_rows, np.int64)
            for a, b, _, doc, *_ in _blocks(batch.column(3)):
                n[a:b] = np.bincount(doc, minlength=b - a)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(n), pa.array(m), batch.column(3)], names=["id", "t", "n_sentences", "maybe", "text"])

    def cut(batches):
        for batch in batches:
            found, texts = batch.column(1).to_pylist(), []
            removed = np.zeros(batch.num_rows, np.int64)
            total = np.zeros(batch.num_rows, np.int64)
            offs, data = textops.utf8(batch.column(2))
            for a, b, o, doc, start, *_ in _blocks(batch.column(2)):
                first = np.searchsorted(doc, np.arange(b - a + 1))
                raw = data[offs[a]:offs[b]]
                for i in range(b - a):
                    own = start[first[i]:first[i + 1]]
                    lead, stop = int(o[i]), int(o[i + 1])
                    drop = np.zeros(len(own), bool)
                    for r in found[a + i] or ():
                        drop[r["first"]:r["first"] + r["size"]] = True
                    total[a + i], removed[a + i] = len(own), int(drop.sum())
                    if not drop.any():
                        texts.append(raw[lead:stop].tobytes().decode())
                        continue
                    edge = np.append(own, stop)
                    edge[0] = lead
                    texts.append(b"".join(raw[edge[j]:edge[j + 1]].tobytes() for j in np.flatnonzero(~drop)).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total), pa.array(removed), pa.array(texts, pa.string())], names=["id", "n_sentences", "n_removed", "text"])

    tagged = base.select(F.xxhash64("id", "t").alias("h"), "id", "t", "text").mapInArrow(whole, f"id {kind}, t bigint, n_sentences bigint, maybe boolean, text string")
    keep = tagged.filter("NOT maybe").select("id", "n_sentences", F.lit(0).cast("bigint").alias("n_removed"), "text")
    some = tagged.filter("maybe").alias("d").join(gone.alias("g"), F.col("d.id").eqNullSafe(F.col("g.id")) & (F.col("d.t") == F.col("g.t")), "left")
    some = some.select(F.col("d.id").alias("id"), "runs", F.col("d.text").alias("text")).mapInArrow(cut, out)
    return keep.unionByName(some).select(F.col("id").alias(id_col), "n_sentences", "n_removed", "text")
