"""Buffered shuffle (S14, R2) against a sequential simulation."""

import pytest
from pyspark.sql import functions as F

from shardwright.operators import buffered


def simulate(rows, reader, seed, size):
    """The swap buffer, one row at a time."""
    held, out = [], []
    for k, row in enumerate(rows):
        if len(held) < size:
            held.append(row)
        else:
            s = buffered.seat(seed, reader, k, size)
            out.append(held[s])
            held[s] = row
    return out + [held[s] for s in sorted(range(len(held)), key=lambda s: buffered.leave_key(seed, reader, s))]


@pytest.mark.parametrize("size", [1, 7, 100, 5000])
def test_equals_sequential_simulation(spark, size):
    sizes = {"a": 1, "b": 40, "c": 3000, "d": 4100, "": 9}
    rows = [(r, k, f"{r}{k}") for r, n in sizes.items() for k in range(n)]
    df = spark.createDataFrame(rows, "reader string, k int, position string")
    got = buffered.buffered_shuffle(df, size, seed=5, reader="reader", order=("k",), out="at").collect()
    for r, n in sizes.items():
        own = sorted((x.at, x.k) for x in got if x.reader == r)
        assert [a for a, _ in own] == list(range(n))
        assert [k for _, k in own] == simulate(list(range(n)), r, 5, size)
    assert all(x.position == f"{x.reader}{x.k}" for x in got) and len(got) == len(rows)


def test_without_reader_nothing_is_exchanged(spark, tmp_path):
    spark.range(9000).select("id", F.lit(None).cast("string").alias("empty")).repartition(3).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    shuffled = buffered.buffered_shuffle(df, 50)
    assert "Exchange" not in shuffled._jdf.queryExecution().executedPlan().toString()
    got = shuffled.withColumn("p", F.spark_partition_id()).collect()
    assert sorted(r.id for r in got) == list(range(9000))
    plain = {}
    for r in df.withColumn("p", F.spark_partition_id()).collect():
        plain.setdefault(r.p, []).append(r.id)
    for p, ids in plain.items():
        assert [r.id for r in sorted((x for x in got if x.p == p), key=lambda x: x.position)] == simulate(ids, str(p), 1234, 50)


def test_null_readers_and_empty_tables(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("", 3)], "reader string, k int")
    got = buffered.buffered_shuffle(df, 10, reader="reader", order=("k",)).collect()
    assert sorted(r.position for r in got) == [0, 0, 1]
    assert buffered.buffered_shuffle(df.limit(0), 10, reader="reader").count() == 0
    with pytest.raises(ValueError):
        buffered.buffered_shuffle(df, 0)
