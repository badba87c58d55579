"""Token-shard files as a Spark data source."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardwright.sources import shard_source as ss


@pytest.fixture(scope="module")
def rows(spark):
    """Files of 1, 5, 2,000 and 70,000 tokens, as writer rows in pieces."""
    out = []
    for name, n in (("a-000-00000.data", 1), ("a-000-00001.data", 5), ("b-001-00000.data", 2000), ("b-001-00001.data", 70000)):
        for at in range(0, n, 700):
            out.append((name, at, n, 3, [(at + k) % 5000 for k in range(min(700, n - at))]))
    return spark.createDataFrame(out, "file_name string, file_offset bigint, num_tokens bigint, num_special_tokens bigint, ids array<int>")


def arranged(df):
    return df.repartition(3, F.xxhash64("file_name")).sortWithinPartitions("file_name", "file_offset")


@pytest.fixture(autouse=True)
def source(spark):
    ss.register(spark)


def write(df, path, **options):
    w = df.write.format(ss.FORMAT).mode(options.pop("mode", "append"))
    for k, v in options.items():
        w = w.option(k, v)
    w.save(path)


@pytest.mark.parametrize("dtype", ["i2", "i4", "i8"])
def test_round_trip_by_ranges(spark, rows, tmp_path, dtype):
    path = str(tmp_path / "out")
    write(arranged(rows), path, dtype=dtype)
    assert sorted(os.listdir(path)) == ["a-000-00000.data", "a-000-00001.data", "b-001-00000.data", "b-001-00001.data"]
    raw = (tmp_path / "out" / "a-000-00001.data").read_bytes()
    assert struct.unpack("<4siiii", raw[:20]) == (b"XLLM", 1, 5, 3, ss.DTYPES.index(dtype))
    assert np.frombuffer(raw[20:], f"<{dtype}").tolist() == [0, 1, 2, 3, 4]
    for split in (1000, 64 << 20):  # many tasks to a file, all files in one task
        df = spark.read.format(ss.FORMAT).option("chunk_tokens", 512).option("split_bytes", split).load(path)
        got = {}
        for r in df.collect():
            got.setdefault(os.path.basename(r.path), {})[r.chunk_no] = r
        assert {k: len(v) for k, v in got.items()} == {"a-000-00000.data": 1, "a-000-00001.data": 1, "b-001-00000.data": 4, "b-001-00001.data": 137}
        for name, n in (("b-001-00001.data", 70000), ("b-001-00000.data", 2000)):
            chunks = [got[name][k] for k in sorted(got[name])]
            assert [r.start for r in chunks] == list(range(0, n, 512))
            assert [x for r in chunks for x in r.ids] == [k % 5000 for k in range(n)]
    assert spark.read.format(ss.FORMAT).option("split_bytes", 1000).load(path).rdd.getNumPartitions() > 100


def test_failed_task_leaves_no_file(spark, rows, tmp_path):
    path = str(tmp_path / "out")
    broken = rows.withColumn("num_tokens", F.when(F.col("file_name") == "b-001-00001.data", F.col("num_tokens") + 1).otherwise(F.col("num_tokens")))
    with pytest.raises(Exception, match="its rows say"):
        write(arranged(broken), path)
    assert not os.path.exists(path) or os.listdir(path) == []
    gap = rows.filter("NOT (file_name = 'b-001-00000.data' AND file_offset = 700)")
    with pytest.raises(Exception, match="came after"):
        write(arranged(gap), path)
    wide = rows.withColumn("ids", F.transform("ids", lambda x: x + 40000))
    with pytest.raises(Exception, match="does not fit"):
        write(arranged(wide), path, dtype="i2")
    assert not os.path.exists(path) or os.listdir(path) == []


def test_existing_files_are_kept_or_replaced(spark, rows, tmp_path):
    path = str(tmp_path / "out")
    first = rows.filter("file_name LIKE 'a%'")
    write(arranged(first), path)
    with pytest.raises(Exception, match="there already"):
        write(arranged(rows), path)
    assert sorted(os.listdir(path)) == ["a-000-00000.data", "a-000-00001.data"]
    write(arranged(rows.filter("file_name LIKE 'b%'")), path)
    assert len(os.listdir(path)) == 4
    write(arranged(first), path, mode="overwrite")
    assert sorted(os.listdir(path)) == ["a-000-00000.data", "a-000-00001.data"]
    scattered = rows.repartition(8, "file_name", "file_offset").sortWithinPartitions("file_offset")
    with pytest.raises(Exception):
        write(scattered, str(tmp_path / "other"))


def test_bad_files_and_empty_folders(spark, rows, tmp_path):
    (tmp_path / "x-000-00000.data").write_bytes(b"XLLM" + b"\0" * 30)
    with pytest.raises(Exception, match="token-shard header"):
        spark.read.format(ss.FORMAT).load(str(tmp_path)).collect()
    (tmp_path / "x-000-00000.data").write_bytes(struct.pack("<4siiii", b"XLLM", 1, 9, 0, 1) + b"\0" * 8)
    with pytest.raises(Exception, match="its header says"):
        spark.read.format(ss.FORMAT).load(str(tmp_path)).collect()
    (tmp_path / "x-000-00000.data").write_bytes(struct.pack("<4siiii", b"XLLM", 1, 0, 0, 1))
    assert spark.read.format(ss.FORMAT).load(str(tmp_path)).count() == 0
    empty = tmp_path / "none"
    write(arranged(rows.limit(0)), str(empty))
    assert spark.read.format(ss.FORMAT).load(str(empty)).count() == 0


def test_missing_columns_raise(spark, rows, tmp_path):
    with pytest.raises(Exception, match="missing: num_tokens"):
        write(rows.drop("num_tokens"), str(tmp_path / "out"))


def test_plan_of_ranges():
    parts = ss.plan_ranges([("a", 250), ("b", 20), ("c", 30), ("d", 100)], 100)
    assert parts == [[("a", 0, 100)], [("a", 100, 200)], [("a", 200, 250), ("b", 0, 20), ("c", 0, 30)], [("d", 0, 100)]]
    assert ss.plan_ranges([("z", 0)], 10) == [[("z", 0, 0)]]
