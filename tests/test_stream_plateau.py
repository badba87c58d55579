"""The plateau stream: runs are counted in groups, events arrive by time."""

import math
import os
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from shardwright.plans import stream_plans
from shardwright.streaming import incremental

T0 = datetime(2024, 1, 1)
SCHEMA = "run long, event_id long, ts timestamp_ntz, value double"


def _events(n: int, runs: int):
    """Event ids against time, times shared by runs, missing losses."""
    rnd = random.Random(7)
    values = (None, float("nan"), 2000.0, float("-inf"))
    return [(None if i % runs == 3 else (1 << 60) + i % runs, n - i, T0 + timedelta(seconds=i // (2 * runs)),
             values[i % 4] if i % 11 == 0 and i > n // 3 else round(900 * math.exp(-i / n) + rnd.randrange(60), 1))
            for i in range(n)]


def _counted(rows, limit: int):
    """``(run, event_id): (step, best, improved, bad, alert)``, event by event."""
    seen, out = {}, {}
    for run, event, ts, value in sorted(rows, key=lambda r: (r[2], r[1])):
        step, best, last = seen.get(run, (0, 1000.0, -1))
        better = None if value is None else bool(value < best)
        if better:
            best, last = value, step
        seen[run] = step + 1, best, last
        out[run, event] = step, best, better, step - last, step - last >= limit
    return out


def test_groups_of_runs_carry_every_counter(spark, tmp_path):
    """a call and a state value for each run, however few its events."""
    rows, groups = _events(3000, 200), 5
    inp, out, ckpt = (str(tmp_path / k) for k in ("in", "out", "ckpt"))
    files = stream_plans._write_ordered_files(spark.createDataFrame(rows, SCHEMA), "ts", 12, inp)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", math.ceil(files / 4)).json(inp)
    incremental.run_to_parquet(incremental.plateau_stream(stream, 3, groups=groups), out, ckpt, state_partitions=2)
    got = {(r.run, r.event_id): (r.step, r.best, r.improved, r.bad, r.alert) for r in spark.read.parquet(out).collect()}
    assert len(os.listdir(out)) == 4
    assert got == _counted(rows, 3)
    assert spark.read.format("statestore").load(ckpt).count() <= groups + 1  # one more for the missing run


def test_events_arrive_by_time_not_by_id(spark, tmp_path):
    """files were ranges of event_id, right only if ids follow time."""
    rows = _events(600, 7)
    events = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("run", "user_id")
    events.write.parquet(str(tmp_path / "events.parquet"))
    got = entry.queries()["stream_plateau"](spark, str(tmp_path)).collect()
    assert {(r.run, r.event_id): (r.step, r.best, r.improved, r.bad, r.alert) for r in got} == _counted(rows, 3)


@pytest.mark.parametrize("files", [1, 7])
def test_ordered_files_are_ranges_in_time_order(spark, tmp_path, files):
    df = spark.range(1000).select(((F.col("id") * 7919) % 500).alias("k"), F.col("id").alias("v")) \
        .withColumn("k", F.when(F.col("v") != 5, F.col("k")))
    n = stream_plans._write_ordered_files(df, "k", files, str(tmp_path / "f"))
    found = sorted((p for p in (tmp_path / "f").iterdir() if p.name.startswith("part-")), key=os.path.getmtime)
    assert len(found) == n == files
    keys = [pd.read_json(p, lines=True).get("k") for p in found]
    spans = [(k.min(), k.max()) for k in keys]
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:])) and sum(len(k) for k in keys) == 1000
    assert keys[-1].isna().sum() == 1
