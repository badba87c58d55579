"""Ids as bytes on their way through the packing stream, ids as text."""

from pyspark.sql import functions as F

from shardwright.functions import tokens
from shardwright.plans import stream_plans
from shardwright.streaming import incremental

ROWS = [[1, 2, 65535], [], None, [70000, 0], [5] * 3000, [2**31 - 1]]


def test_ids_as_bytes(spark, monkeypatch):
    import numpy as np
    df = spark.createDataFrame(list(enumerate(ROWS)), "k int, ids array<int>").coalesce(1)
    for limit in (tokens.BLOCK_BYTES, 1):
        monkeypatch.setattr(tokens, "BLOCK_BYTES", limit)
        got = {r.k: r.b for r in df.select("k", tokens.to_bytes("ids").alias("b")).collect()}
        assert [np.frombuffer(got[k].ids, "<i4" if got[k].wide else "<u2").tolist() for k in range(len(ROWS))] \
            == [r or [] for r in ROWS]
    blob = spark.createDataFrame([(k, bytearray(np.array(r or [], "<i4").tobytes())) for k, r in enumerate(ROWS)], "k int, b binary")
    back = {r.k: r.ids for r in blob.select("k", tokens.from_bytes("b").alias("ids")).collect()}
    assert [back[k] for k in range(len(ROWS))] == [r or [] for r in ROWS]


def test_joined_ids_equal_array_join(spark):
    rows = ROWS + [[-3, 4], [7]]
    df = spark.createDataFrame(list(enumerate(rows)), "k int, ids array<int>").coalesce(1)
    for one in (df, df.filter("k in (0, 1, 2, 4, 7)"), df.filter("k = 2")):
        assert one.filter(~F.array_join("ids", ",").eqNullSafe(tokens.joined("ids"))).count() == 0


def test_ids_cross_the_state_step_as_bytes(spark, tmp_path):
    """lists of ids were taken apart one by one in both directions."""
    docs = spark.createDataFrame([(k, [9 + k] * 50 if k != 4 else [80000] * 50) for k in range(8)] + [(8, None)], "doc_id long, ids array<int>")
    inp, out, ckpt = (str(tmp_path / k) for k in ("in", "out", "ckpt"))
    stream_plans._write_ordered_files(docs, "doc_id", 3, inp)
    stream = spark.readStream.schema("doc_id long, ids array<int>").option("maxFilesPerTrigger", 1).json(inp)
    w = incremental.pack_stream(stream.withColumn("shard", F.lit(0)), 64)
    plan = w._jdf.queryExecution().logical().toString()
    assert "_to_bytes" in plan and "_from_bytes" in plan
    incremental.run_to_parquet(w, out, ckpt, state_partitions=1, rocksdb=True)
    flat = [x for k in range(8) for x in ([9 + k] * 50 if k != 4 else [80000] * 50)]
    got = {r.win: (r.first_doc_id, r.input_ids) for r in spark.read.parquet(out).collect()}
    assert got == {i: (i * 64 // 50, flat[i * 64:i * 64 + 64]) for i in range(len(flat) // 64)}
    kept = incremental.pack_stream(stream.withColumn("shard", F.lit(0)), 64, as_bytes=True)
    incremental.run_to_parquet(kept, out + "2", ckpt + "2", state_partitions=1, rocksdb=True)
    back = spark.read.parquet(out + "2").select("win", "first_doc_id", tokens.from_bytes("input_ids").alias("input_ids"))
    assert {r.win: (r.first_doc_id, r.input_ids) for r in back.collect()} == got
