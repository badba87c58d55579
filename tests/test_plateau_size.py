"""Bucket totals of the plateau counter and of running aggregates at size."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from shardwright.operators import ordering, reports
from sf_paths import SF_SMALL


def test_bucket_totals_grow_with_the_runs_not_the_events(spark, monkeypatch):
    """one total per (run, hour) was nearly one per event."""
    rows = []
    real = ordering.materialize

    def counted(session, df, name):
        out = real(session, df, name)
        rows.append(out.count())
        return out

    monkeypatch.setattr(ordering, "materialize", counted)
    n = entry.queries()["plateau_alert"](spark, SF_SMALL).count()
    runs = spark.read.parquet(f"{SF_SMALL}/events.parquet").select("user_id").distinct().count()
    assert n > runs and max(rows) <= runs


def test_many_bucket_totals_are_not_broadcast(spark, monkeypatch):
    """their compressed size says little about the memory they take."""
    df = spark.range(5000).withColumn("v", F.col("id") % 7)
    monkeypatch.setattr(ordering, "BROADCAST_ROWS", 100)
    out = ordering.running_sum(df, "v", ["id"], bucket=F.col("id"), out="s", inclusive=True)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    last = out.orderBy(F.desc("id")).first()
    assert last.s == sum(i % 7 for i in range(5000))


def test_plateau_over_buckets_with_missing_and_equal_losses(spark):
    losses = [2000.0, None, 5.0, 5.0, None, 4.0, float("nan"), 4.0, 3.0, 7.0]
    df = spark.createDataFrame([(r, i, x) for r in (1, None) for i, x in enumerate(losses)], "run long, i long, loss double")
    want = [(0, 1000.0, False, 1), (1, 1000.0, None, 2), (2, 5.0, True, 0), (3, 5.0, False, 1), (4, 5.0, None, 2),
            (5, 4.0, True, 0), (6, 4.0, False, 1), (7, 4.0, False, 2), (8, 3.0, True, 0), (9, 3.0, False, 1)]
    for bucket in (None, F.floor(F.col("i") / 3)):
        got = reports.plateau(df, "run", ["i"], "loss", 2, bucket=bucket)
        for run in (F.col("run") == 1, F.col("run").isNull()):
            rows = got.filter(run).orderBy("i").collect()
            assert [(r.step, r.best, r.improved, r.bad) for r in rows] == want
            assert [r.alert for r in rows] == [b >= 2 for *_, b in want]
