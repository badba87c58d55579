"""Shuffles, weights and weighted interleaving of corpora.

Weighted interleave without replacement (draw the next item from corpus i
with probability w_i / sum of the weights of the corpora not yet exhausted,
keep the order inside each corpus) is the same as racing exponential
clocks: item k of corpus i arrives at the sum of k + 1 independent
Exp(w_i) gaps, and the stream is everything sorted by arrival. Exhausted
corpora simply stop arriving, which is the renormalisation. So the mix is a
running sum per corpus plus one global sort: no sequential loop, and every
step splits into buckets (``ordering``).

Arrival times are fixed-point integers (gap * 1e6, floored), so sums are
exact in any order and the same in any engine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import order_key, uniform
from .ordering import bucket_hex, bucket_numeric, ordinal, running_sum

CLOCK_SCALE = 1_000_000


def shuffle_rows(df: DataFrame, seed, id_col: str, out: str = "position") -> DataFrame:
    """Global seeded shuffle; ``out`` = 0-based position in the
    order ``md5(seed:id)`` (ties by id), computed by buckets of the hash."""
    x = df.withColumn("__key", order_key(seed, F.col(id_col)))
    return ordinal(x, ["__key", id_col], bucket=bucket_hex("__key", 4), out=out).drop("__key")


def weights_by_count(counts: DataFrame, count_col: str = "samples", out: str = "weight") -> DataFrame:
    """Each corpus's count over the total (one row per corpus)."""
    total = counts.agg(F.sum(count_col)).scalar()
    return counts.withColumn(out, F.col(count_col).cast("double") / total.cast("double"))


def normalise(weights: DataFrame, weight_col: str, out: str = "weight") -> DataFrame:
    """Weights divided by their sum."""
    total = weights.agg(F.sum(weight_col)).scalar()
    return weights.withColumn(out, F.col(weight_col).cast("double") / total.cast("double"))


def _needed(value: Column, ok: Column, what: str, corpus: str) -> Column:
    """``value`` where ``ok``, else an error that names the corpus."""
    fail = F.raise_error(F.concat(F.lit(f"no {what} for corpus "), F.coalesce(F.col(corpus).cast("string"), F.lit("null"))))
    return F.when(ok, value).otherwise(fail.cast("double"))


def interleave(items: DataFrame, corpus: str, position: str, weights: DataFrame, seed,
               weight_col: str = "weight", out: str = "mix_position",
               bucket_width: int | None = None) -> DataFrame:
    """Weighted interleave of corpora. ``items`` has the corpus and the
    0-based ``position`` of the item inside its corpus; ``weights`` one row
    per corpus (they need not sum to one). Adds ``arrival`` and the 0-based
    ``out`` in the mixed stream (ties by corpus, then position). A corpus
    without a positive weight raises an error."""
    w = weights.select(corpus, F.col(weight_col).cast("double").alias("__w"))
    total = w.agg(F.sum("__w")).scalar()
    x = items.join(w, on=corpus, how="left")   # one row per corpus: AQE broadcasts it by size
    x = x.withColumn("__w", _needed(F.col("__w"), F.col("__w") > 0, "weight", corpus))
    key = F.concat_ws(":", F.col(corpus).cast("string"), F.col(position).cast("string"))
    gap = F.floor(-F.log(uniform(seed, key)) / F.col("__w") * F.lit(float(CLOCK_SCALE))).cast("bigint")
    x = x.withColumn("__gap", gap)
    x = running_sum(x, "__gap", [position], by=[corpus],
                    bucket=bucket_numeric(position, 1 << 16), out="arrival", inclusive=True)
    # arrivals come at a rate of the sum of the weights per CLOCK_SCALE:
    # buckets of ~64k items on average, whatever the weights sum to
    bucket = bucket_numeric("arrival", bucket_width) if bucket_width else \
        F.floor(F.col("arrival") * total / F.lit(float(CLOCK_SCALE << 16))).cast("bigint")
    return ordinal(x.drop("__gap", "__w"), ["arrival", corpus, position], bucket=bucket, out=out)


def slots(files: DataFrame, n_slots: int, file_position: str, out: str = "slot") -> DataFrame:
    """File at position p reads in slot ``p mod b``."""
    return files.withColumn(out, F.pmod(F.col(file_position), F.lit(n_slots)).cast("int"))


def repeat_epochs(df: DataFrame, n_epochs: int, out: str = "epoch") -> DataFrame:
    """The table ``n_epochs`` times, with an ``epoch`` column
    (a generator per row, not a join)."""
    if n_epochs < 1:
        raise ValueError("epochs must be a positive number")
    return df.withColumn(out, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_epochs - 1).cast("bigint"))))


def skip_allotment(weights: DataFrame, skip: int, weight_col: str = "weight", out: str = "skip") -> DataFrame:
    """``round(skip * w)`` per corpus, half to even."""
    return weights.withColumn(out, F.bround(F.lit(float(skip)) * F.col(weight_col), 0).cast("bigint"))


def apply_skip(items: DataFrame, allot: DataFrame, corpus: str, position: str, skip_col: str = "skip") -> DataFrame:
    """Drop the first ``skip`` items of each corpus; a corpus without an
    allotment raises an error."""
    a = allot.select(corpus, F.col(skip_col).cast("double").alias("__skip"))
    x = items.join(a, on=corpus, how="left")
    return x.filter(F.col(position) >= _needed(F.col("__skip"), F.col("__skip").isNotNull(), "allotment", corpus)).drop("__skip")

__all__: Sequence[str] = ["shuffle_rows", "weights_by_count", "normalise", "interleave", "slots",
                          "repeat_epochs", "skip_allotment", "apply_skip"]
