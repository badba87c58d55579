"""Operator 4: quality by importance resampling.

Two generative models over hashed n-grams (words and word pairs, 2**22
buckets): the target model counts labelled good texts, the raw model counts
every text of the corpus. Both count a text once, however many copies it
has: copies need not be labelled like other rows. A text's log importance
weight is the sum of log ratios target / raw over its n-grams; Gumbel noise
is added and the k largest are kept, which samples k distinct texts without
replacement in proportion to their weights.

A bucket's log ratio is drawn towards 0 by ``shrink`` standard errors of its
expected target count: buckets seen too rarely say nothing.

Counting and scoring are one pass each; shuffled are text hashes (to find the
copies), the texts that have copies (folded per task first), the tasks'
count vectors (compressed, fixed size) and score histograms. The ratios are
broadcast: 16 MB whatever the corpus. Labels enter as a sample of at most
``max_labels`` documents, chosen by hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import sketches, textops

BITS = 22
_CHUNK = 1 << 16


def features(column: pa.Array):
    """Yields ``(a, b, doc, bucket)`` of blocks of texts: words (runs of
    letters and digits, or of other signs; A-Z lower-cased) and word pairs."""
    offs, data = textops.utf8(column)
    for a, b in textops.blocks(offs):
        doc, _, _, h = textops.words(data[offs[a]:offs[b]], offs[a:b + 1] - offs[a], textops.byte_class("tokens"), textops.ascii_fold())
        two, _, g = textops.ngrams(doc, h, 2, b - a, whole_short=False)
        yield a, b, np.concatenate((doc, two)), (np.concatenate((h, g)) >> np.uint64(64 - BITS)).astype(np.int64)


def _distinct(base: DataFrame, sample: DataFrame) -> tuple[DataFrame, object]:
    """``(bits, text, t, alone)`` and the bitmap of the texts that have
    copies. Those are one row each, folded before the shuffle, with the
    labels of their rows OR-ed. The other texts stay where they are
    (``alone``); rows there that the bitmap knows are not to be counted."""
    spark = base.sparkSession
    tagged = base.join(F.broadcast(sample), "h", "left").select("t", "text", F.coalesce("bits", F.lit(0)).alias("bits"))
    bitmap = sketches.share(spark, sketches.key_bitmap(base.groupBy("t").count().filter("count > 1"), "t"))
    copied = tagged.filter(sketches.maybe_in(bitmap)("t")).groupBy("t").agg(F.bit_or("bits").alias("bits"), F.first("text").alias("text"))
    cols = ["bits", "text", "t"]
    return tagged.select(*cols, F.lit(True).alias("alone")).unionByName(copied.select(*cols, F.lit(False).alias("alone"))), bitmap


def _counts(texts: DataFrame, bitmap) -> DataFrame:
    """``(model, chunk, packed)``: count chunks of the raw (0) and the target
    model (1); model 2 holds the numbers of labelled and of good texts. A
    text is good if all its labels are."""
    names = ["model", "chunk", "task", "packed"]

    def run(batches):
        total = np.zeros((2, 1 << BITS), np.uint32)
        labelled = np.zeros(2, np.int64)
        for batch in batches:
            alone = batch.column(3).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(~(alone & sketches.in_bitmap(bitmap.value, batch.column(2).to_numpy()))))
            bits = batch.column(0).to_numpy(zero_copy_only=False)
            is_good = bits == 2
            labelled += (bits > 0).sum(), is_good.sum()
            for a, b, doc, f in features(batch.column(1)):
                np.add.at(total[0], f, 1)
                np.add.at(total[1], f[is_good[a:b][doc]], 1)
        task = TaskContext.get().partitionId()

        def row(model, c, x):
            return pa.RecordBatch.from_arrays([pa.array([model], pa.int32()), pa.array([c], pa.int32()), pa.array([task], pa.int32()),
                                               pa.array([sketches.pack_counts(x)], pa.binary())], names=names)

        for model in (0, 1):
            for c in np.flatnonzero(total[model].reshape(-1, _CHUNK).any(axis=1)).tolist():
                yield row(model, c, total[model][c * _CHUNK:(c + 1) * _CHUNK])
        yield row(2, 0, labelled)

    parts = texts.mapInArrow(run, "model int, chunk int, task int, packed binary")
    return sketches.merge_tasks(parts, ["model", "chunk"], sketches.add_counts, sketches.pack_counts)


def log_ratios(raw: np.ndarray, target: np.ndarray, scale: float, shrink: float = 3.0, prior: float = 0.5) -> np.ndarray:
    """Per bucket log(target / raw), zero where the counts do not show it;
    ``scale`` is the target's n-grams over the raw ones."""
    expected = raw * scale
    ratio = np.log((target + prior) / (expected + prior))
    error = shrink / np.sqrt(expected + prior)
    return (np.sign(ratio) * np.maximum(np.abs(ratio) - error, 0)).astype(np.float32)


def label_sample(labels: DataFrame, id_col: str, max_labels: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashed ids of the label sample and whether each is good: every
    label of the document says quality 1 and toxic 0 (null is not good)."""
    good = F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))
    one = materialize(labels.sparkSession, labels.filter(F.col(id_col).isNotNull()).groupBy(F.xxhash64(id_col).alias("h"))
                      .agg(F.min(good).alias("good")).withColumn("place", F.xxhash64("h")), "labels")
    # places are uniform: a bound that some more than max_labels rows pass, then the smallest of those
    bound = sketches.hash_bound(one.count(), max_labels)
    rows = sorted((r.h, r.good) for r in one.filter(F.col("place").cast("double") <= bound).orderBy("place", "h").limit(max_labels).collect())
    return np.array([h for h, _ in rows], np.int64), np.array([g for _, g in rows], bool)


def _noisy(weight: np.ndarray, draw: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Weights plus Gumbel noise, and bigints of the same order."""
    u = draw.to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(11)
    score = weight - np.log(-np.log((u + 0.5) / 2.0 ** 53))
    bits = score.view(np.int64)
    return score, np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def weigh(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_share: float | None = None,
          max_labels: int = 50_000, seed: int = 17) -> DataFrame:
    """One row per input row: ``id_col, log_weight, score, kept``.

    ``score`` is the weight plus Gumbel noise drawn from a hash of the text,
    so copies share score and decision. Of the distinct texts the ``k`` with
    the largest scores are kept, ties with the k-th too, with all their
    rows; ``k = round(keep_share * texts)``, by default with the share of
    good ones among the labelled texts. Null and empty texts have weight 0.
    Without labels (or without a good one) all ratios are 1, and without a
    share all rows are kept. Other columns are ignored. An empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    textops.bounded_batches(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.xxhash64(id_col).alias("h"), text.alias("text"), F.col(id_col).alias("id"), F.xxhash64(text).alias("t"))
    ids, good = label_sample(labels, id_col, max_labels)
    sample = spark.createDataFrame([(int(h), 1 + int(g)) for h, g in zip(ids, good)], "h bigint, bits int")  # max_labels rows at most
    texts, bitmap = _distinct(base, sample)
    packed = {(m, c): raw for m, c, raw in _counts(texts, bitmap).select("model", "chunk", "packed").collect()}  # 129 rows of a fixed size
    bitmap.destroy()
    zero = np.zeros(_CHUNK, np.int64)
    read = lambda m, c: sketches.unpack_counts(packed[m, c]) if (m, c) in packed else zero
    chunks = range((1 << BITS) // _CHUNK)
    raw_n, target_n = (sum(int(read(m, c).sum()) for c in chunks) for m in (0, 1))
    table = np.zeros(1 << BITS, np.float32)
    for c in chunks if target_n else ():  # a chunk at a time: the driver never holds all counts
        table[c * _CHUNK:(c + 1) * _CHUNK] = log_ratios(read(0, c), read(1, c), target_n / max(raw_n, 1))
    ratio = spark.sparkContext.broadcast(table)

    def run(batches):
        for batch in batches:
            w = np.zeros(batch.num_rows)
            for a, b, doc, f in features(batch.column(1)):
                w[a:b] = np.bincount(doc, ratio.value[f], b - a)
            score, place = _noisy(w, batch.column(4))
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), pa.array(w), pa.array(score), pa.array(place)],
                                             names=["id", "t", "log_weight", "score", "place"])

    kind = dict(base.dtypes)["id"]
    scored = materialize(spark, base.withColumn("u", F.xxhash64("t", F.lit(seed))).mapInArrow(
        run, f"id {kind}, t bigint, log_weight double, score double, place bigint"), "weights")
    ratio.destroy()
    if keep_share is None and len(ids):
        labelled, fine = read(2, 0)[:2].tolist()
        keep_share = fine / labelled if labelled else float(good.mean())
    if keep_share is None:
        kept = F.lit(True)
    else:
        of_texts = materialize(spark, scored.select("t", "place").distinct(), "text-scores")
        least = kth_largest(of_texts, "place", round(keep_share * of_texts.count()))
        kept = F.lit(False) if least is None else F.col("place") >= least
    return scored.select(F.col("id").alias(id_col), "log_weight", "score", kept.alias("kept"))


def kth_largest(df: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest bigint by four rounds of 16 bits: each round counts
    65,536 classes at most. None for k = 0; the smallest for k beyond all."""
    if k <= 0:
        return None
    known, left, part = 0, k, df
    for shift in (48, 32, 16, 0):
        digit = F.shiftright(column, shift) if shift == 48 else F.shiftright(column, shift).bitwiseAND(0xFFFF)
        rows = part.groupBy(digit.alias("d")).count().collect()
        for d, n in sorted(((r["d"], r["count"]) for r in rows), reverse=True):
            if left <= n:
                break
            left -= n
        else:
            return df.agg(F.min(column)).first()[0]
        known = (known << 16) + d
        part = part.filter(digit == d)
    return known


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", bound: float = -1.5, **how) -> DataFrame:
    """``docs`` without the rejected rows, same columns.

    Here the weight decides, not a rank: a row goes when its log weight is
    below ``bound`` (clearly negative: its n-grams speak against it), so that
    neither noise nor a number to be filled rejects clean documents or keeps
    bad ones. Null and empty texts have weight 0 and stay. Rows that share an id (null
    too) go when one of them is rejected. An empty table stays empty.
    """
    gone = weigh(docs, labels, id_col, **how).filter(F.col("log_weight") < bound).select(F.col(id_col).alias("id")).distinct()
    return sketches.without(docs, materialize(docs.sparkSession, gone, "rejected"), [(F.col(id_col), "id")])
