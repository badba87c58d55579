"""Distribution of files and samples to readers (trainer rank x loader worker)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import running


def balanced_part(pos: Column | str, total: Column | str, n_parts: int) -> Column:
    """Part of the 0-based position ``pos`` when ``total`` items are cut
    into ``n_parts`` contiguous parts, the first ``total mod n`` one longer
    (the ``ntile`` rule, without a global window)."""
    p = F.col(pos) if isinstance(pos, str) else pos
    t = F.col(total) if isinstance(total, str) else total
    m = F.pmod(t, F.lit(n_parts))
    k = _div(t, F.lit(n_parts))
    head = m * (k + 1)
    return F.when(p < head, _div(p, k + 1)).otherwise(m + _div(p - head, F.greatest(k, F.lit(1)))).cast("int")


def _div(a: Column, b: Column) -> Column:
    """Whole quotient of bigints (never through double)."""
    a, b = a.cast("bigint"), b.cast("bigint")
    return F.call_function("div", a, b)


def reader_shard(rank: int, worker: int, workers: int, dispatch: bool) -> int:
    """With ``dispatch`` only the loader worker splits the files."""
    return worker if dispatch else rank * workers + worker


def n_reader_shards(world: int, workers: int, dispatch: bool) -> int:
    return workers if dispatch else world * workers


def worker_skip(skip: int, worker: int, workers: int) -> int:
    """D3: each worker skips ``skip div workers``; worker 0 also the remainder."""
    return skip // workers + (skip % workers if worker == 0 else 0)


def worker_skip_col(skip: int, worker: Column, workers: int) -> Column:
    return F.lit(skip // workers) + F.when(worker == 0, F.lit(skip % workers)).otherwise(F.lit(0))


def resume_position(files: DataFrame, context: int, skip: Column | int, by: Sequence[str] = ("reader",),
                    position: str = "file_position") -> DataFrame:
    """Where reading starts after ``skip`` samples, per reader: the first
    file whose running sample count exceeds ``skip`` and the sample inside
    it; readers that are exhausted give no row. ``files`` holds
    ``num_tokens`` and the file ``position`` in reading order; per-reader
    file lists are short, so the window is by reader."""
    s = F.lit(skip) if isinstance(skip, int) else skip
    x = files.withColumn("samples", F.expr(f"num_tokens div {int(context)}"))
    x = running(x, "samples", "sum", [position], by=list(by), out="__cum", inclusive=True)
    x = x.withColumn("__skip", s)
    prev = F.col("__cum") - F.col("samples")
    return (x.filter((prev <= F.col("__skip")) & (F.col("__skip") < F.col("__cum")))
             .withColumn("start_sample", (F.col("__skip") - prev).cast("bigint"))
             .drop("__cum", "__skip"))


def remaining_samples(files: DataFrame, context: int, skip: Column | int, by: Sequence[str] = ("reader",)) -> DataFrame:
    """Samples of each reader's files minus its skip."""
    s = F.lit(skip) if isinstance(skip, int) else skip
    return files.groupBy(*by).agg(F.sum(F.expr(f"num_tokens div {int(context)}")).alias("samples")) \
        .withColumn("remaining", F.col("samples") - s)
