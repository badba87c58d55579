"""Structured Streaming forms of the incremental and stateful steps.

- ``ingest_new_files`` (Z1): tokenize files as they arrive; the file source
  and its checkpoint remember which files are done, so a restart only
  reads new ones. Each micro-batch overwrites its own output folder
  (``batch=<epoch>``), so a batch re-run after a failure replaces its
  output instead of duplicating it; the manifest row of a file is written
  after its tokens.
- ``pack_stream`` (Z2): training windows over a stream of documents, the
  partial window of each shard carried from batch to batch in state
  (``transformWithStateInPandas``; less than C ids per shard).
- ``plateau_stream`` (Z3): the evaluation-loss plateau counter per run,
  state = (steps seen, best loss, step of the last improvement) of each run
  of a group of runs.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..functions import tokens
from ..operators import packing
from ..operators.reports import PLATEAU_START_LOSS
from ..sources import sinks


# state variables of several kinds need the RocksDB store, which comes with Spark
_STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # a micro-batch commits what it changed, whole copies are made beside it
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


def _run(query_writer, checkpoint: str, spark: SparkSession | None = None,
         state_partitions: int | None = None, rocksdb: bool = False) -> None:
    """Start with ``availableNow`` and wait. ``state_partitions`` fixes the
    number of state-store partitions of a stateful query. Both it and the
    state store are taken from the session when the query starts and kept in
    its checkpoint; the session's own settings are restored right after."""
    ours = {"spark.sql.shuffle.partitions": str(state_partitions)} if state_partitions else {}
    if rocksdb:
        ours.update(_STATE_STORE)
    old = {k: spark.conf.get(k, None) for k in ours}
    for k, v in ours.items():
        spark.conf.set(k, v)
    try:
        q = query_writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def ingest_new_files(spark: SparkSession, input_dir: str, out_dir: str, checkpoint: str, schema: str,
                     text: str = "text", keep: tuple[str, ...] = (), tokenizer=None,
                     max_files_per_trigger: int = 16) -> None:
    """Tokenize (+EOS) every JSON Lines file under ``input_dir`` not yet
    done; output rows ``(*keep, n_tokens, ids)`` under ``out_dir/tokens``,
    done files in ``out_dir/manifest``."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
              .json(input_dir).withColumn("path", F.col("_metadata.file_path")))

    def batch(df: DataFrame, epoch: int) -> None:
        tok = packing.tokenize(df.select(*keep, text, "path"), text, tokenizer=tokenizer).drop(text)
        tok.drop("path").write.mode("overwrite").parquet(os.path.join(out_dir, "tokens", f"batch={epoch}"))
        sinks.append_manifest(df.select("path").distinct(), os.path.join(out_dir, "manifest"), batch=f"epoch-{epoch}")

    _run(stream.writeStream.foreachBatch(batch), checkpoint)


def _in_order(frames: list[pd.DataFrame], order: str):
    """``(order, ids)`` of all rows in order, taken frame by frame: only the
    keys are sorted, no ids are copied together."""
    keys = np.concatenate([f[order].to_numpy(np.int64) for f in frames])
    at = np.repeat(np.arange(len(frames)), [len(f) for f in frames])
    row = np.concatenate([np.arange(len(f)) for f in frames])
    columns = [(f["ids"].to_numpy(), f["wide"].to_numpy(bool)) for f in frames]
    for i in np.argsort(keys, kind="stable"):
        ids, wide = columns[at[i]]
        yield int(keys[i]), np.frombuffer(ids[row[i]], "<i4" if wide[row[i]] else "<u2")


class PackWindows(StatefulProcessor):
    """Windows of one shard. State, one value a shard: the ids of the open
    window (less than a window, 32-bit little-endian), the document it starts
    in and its number."""

    def __init__(self, context: int, order: str, emit: int = 256):
        self.context, self.order, self.emit = context, order, emit

    def init(self, handle) -> None:
        self.open = handle.getValueState("open", "ids binary, first long, win long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803 - Spark's names
        frames = [f for f in rows if len(f)]
        if not frames:
            return
        held, first, win = self.open.get() if self.open.exists() else (b"", -1, 0)
        held = np.frombuffer(held, "<i4")
        window = np.empty(self.context, "<i4")
        window[:len(held)] = held
        filled, done = len(held), []
        for owner, ids in _in_order(frames, self.order):
            at = 0
            while at < len(ids):
                if filled == 0:
                    first = owner
                n = min(self.context - filled, len(ids) - at)
                window[filled:filled + n] = ids[at:at + n]
                filled, at = filled + n, at + n
                if filled == self.context:
                    done.append((key[0], win, first, window.tobytes()))
                    filled, win = 0, win + 1
                    if len(done) == self.emit:
                        yield self._frame(done)
                        done = []
        self.open.update((window[:filled].tobytes(), first, win))
        if done:
            yield self._frame(done)

    def _frame(self, done: list) -> pd.DataFrame:
        return pd.DataFrame(done, columns=["shard", "win", f"first_{self.order}", "input_ids"])


def pack_stream(stream: DataFrame, context: int, shard: str = "shard", order: str = "doc_id",
                as_bytes: bool = False) -> DataFrame:
    """``stream`` has ``(shard, order, ids)``; returns a streaming
    DataFrame of full windows ``(shard, win, first_<order>, input_ids)``.
    Each micro-batch must hold the next rows of every shard (e.g. files in
    order); rows inside a batch are put in order by ``order``. A task holds
    one shard's rows of one micro-batch and ``emit`` windows, so bound the
    batches (``maxBytesPerTrigger``, ``maxFilesPerTrigger``) and let the
    number of shards grow with the input. Ids enter and leave the state step
    as bytes; with ``as_bytes``, ``input_ids`` stays so (little-endian, 32 bits
    an id), which is written and read far faster than a list of a window's
    ids, and ``tokens.from_bytes`` gives the list."""
    rows = stream.select(shard, order, tokens.to_bytes("ids").alias("b")).select(shard, order, "b.ids", "b.wide")
    windows = rows.groupBy(shard).transformWithStateInPandas(
        PackWindows(context, order), outputStructType=f"shard int, win long, first_{order} long, input_ids binary",
        outputMode="append", timeMode="none")
    return windows if as_bytes else windows.withColumn("input_ids", tokens.from_bytes("input_ids"))


# what the plateau counter keeps of a run: steps seen, best loss, step of the last improvement
_COUNTERS = np.dtype([("run", "<i8"), ("step", "<i8"), ("best", "<f8"), ("last", "<i8")])


def _plateau_state(limit: int, order: list[str], event: str):
    def fn(key, pdfs, state):
        held = np.frombuffer(state.get[0] if state.exists else b"", _COUNTERS)
        frames = [f for f in pdfs if len(f)]
        if not frames:
            return
        pdf = pd.concat(frames, ignore_index=True).sort_values(["run", *order])
        run, val = pdf["run"].to_numpy(np.int64), pdf["loss"].to_numpy(float)
        first = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
        size = np.diff(np.append(first, len(run)))
        nth = np.repeat(np.arange(len(first)), size)
        now = np.zeros(len(first), _COUNTERS)
        now["run"], now["best"], now["last"] = run[first], PLATEAU_START_LOSS, -1
        _, old, new = np.intersect1d(held["run"], now["run"], assume_unique=True, return_indices=True)
        now[new] = held[old]

        # a run's held value stands before its rows
        runs, at = np.insert(nth, first, np.arange(len(first))), np.arange(len(run)) + nth + 1
        losses = np.where(np.isnan(val), np.inf, val)  # a missing loss is no improvement
        running = pd.Series(np.insert(losses, first, now["best"])).groupby(runs).cummin().to_numpy()
        improved = val < running[at - 1]
        steps = np.arange(len(run)) - first[nth] + now["step"][nth]
        lasts = pd.Series(np.insert(np.where(improved, steps, -1), first, now["last"])).groupby(runs).cummax().to_numpy()[at]
        best, bad, end = running[at], steps - lasts, first + size - 1
        now["step"], now["best"], now["last"] = now["step"] + size, best[end], lasts[end]
        state.update((np.concatenate((np.delete(held, old), now)).tobytes(),))
        yield pd.DataFrame({
            "run": pd.arrays.IntegerArray(run, np.full(len(run), key[1])), event: pdf[event].to_numpy(np.int64),
            "step": steps, "best": best, "improved": pd.arrays.BooleanArray(improved, pdf["missing"].to_numpy(bool)),
            "bad": bad.astype(np.int32), "alert": bad >= limit})
    return fn


def plateau_stream(stream: DataFrame, limit: int, run: str = "run", order=("ts", "event_id"),
                   loss: str = "value", event: str = "event_id", groups: int = 256) -> DataFrame:
    """Z3: per evaluation ``(run, event, step, best, improved, bad, alert)``
    as in ``reports.plateau``, with the counters carried in state. Runs are
    dealt to ``groups`` by hash, and a group's runs are counted together: a
    call for each run costs far more than its few rows. A task holds one
    group's rows of one micro-batch, so let the groups grow with the input."""
    no_run = F.col(run).isNull()
    rows = stream.select(F.pmod(F.xxhash64(run), F.lit(groups)).alias("group"), no_run.alias("no_run"),
                         F.coalesce(F.col(run), F.lit(0)).cast("long").alias("run"), *order,
                         F.col(loss).cast("double").alias("loss"), F.col(loss).isNull().alias("missing"))
    return rows.groupBy("group", "no_run").applyInPandasWithState(
        _plateau_state(limit, list(order), event),
        outputStructType=f"run long, {event} long, step long, best double, improved boolean, bad int, alert boolean",
        stateStructType="counters binary",
        outputMode="append", timeoutConf=GroupStateTimeout.NoTimeout)


def run_to_parquet(stream_df: DataFrame, out_dir: str, checkpoint: str,
                   state_partitions: int | None = None, rocksdb: bool = False) -> None:
    """Drain a streaming DataFrame (available input only) into Parquet,
    one overwritten folder per micro-batch. Stateful queries get
    ``state_partitions`` state-store partitions (default: the context's
    parallelism, i.e. one per core); ``rocksdb`` is needed by ``pack_stream``."""
    spark = stream_df.sparkSession
    parts = state_partitions or spark.sparkContext.defaultParallelism

    def batch(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").option("compression", "zstd").parquet(os.path.join(out_dir, f"batch={epoch}"))
    _run(stream_df.writeStream.foreachBatch(batch), checkpoint, spark, parts, rocksdb)
