"""Inputs that used to lose rows without notice: null keys, corpora without
weights, deep trees, malformed raw files, second runs into one folder."""

import io
import json
import os
import tarfile

import pytest
from pyspark.sql import functions as F

from shardwright.operators import chat, mixing, packing
from shardwright.operators.ordering import bucket_numeric, count_by, ordinal, running_sum
from shardwright.operators.pretokenize import pretokenize
from shardwright.session import scratch_path
from shardwright.sources import readers, sinks


def test_null_keys_and_buckets_keep_their_rows(spark):
    rows = [(None, 1, 5), (None, 2, 7), ("a", 1, 1), ("a", None, 2), ("b", 3, 4)]
    df = spark.createDataFrame(rows, "k string, p long, v long")
    got = running_sum(df, "v", ["p"], by=["k"], bucket=bucket_numeric("p", 2), out="s", inclusive=True).collect()
    assert sorted(((r.k, r.p, r.s) for r in got), key=repr) == sorted(
        [(None, 1, 5), (None, 2, 12), ("a", None, 2), ("a", 1, 3), ("b", 3, 4)], key=repr)
    assert count_by(df, ["k"]).count() == 5
    assert ordinal(df, ["k", "p"], bucket=F.lit(None).cast("bigint")).count() == 5


def test_two_level_totals(spark):
    """More buckets than one group of the second level holds."""
    df = spark.range(30_000).withColumn("v", F.lit(1))
    got = running_sum(df, "v", ["id"], bucket=F.col("id"), out="s")
    assert got.filter("s != id").count() == 0 and got.count() == 30_000


def test_chained_ordinals_read_their_input_once(spark):
    path = scratch_path(spark, "t-linear")
    spark.range(100).write.parquet(path)
    df = spark.read.parquet(path)
    for k in range(5):
        df = ordinal(df, ["id"], bucket=bucket_numeric("id", 10), out=f"o{k}")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") <= 1 + 5 * 3  # the input, and each step's small totals
    assert df.filter(" or ".join(f"o{k} != id" for k in range(5))).count() == 0


def test_mix_needs_every_weight(spark):
    items = spark.createDataFrame([("a", 0), ("b", 0)], "corpus string, pos long")
    some = spark.createDataFrame([("a", 0.5)], "corpus string, weight double")
    with pytest.raises(Exception, match="no weight for corpus b"):
        mixing.interleave(items, "corpus", "pos", some, 1).collect()
    skip = spark.createDataFrame([("a", 0)], "corpus string, skip long")
    with pytest.raises(Exception, match="no allotment for corpus b"):
        mixing.apply_skip(items, skip, "corpus", "pos").collect()


def test_tiny_weights_keep_buckets_large(spark):
    items = spark.range(20_000).select(F.lit("a").alias("corpus"), F.col("id").alias("pos"))
    w = spark.createDataFrame([("a", 0.001)], "corpus string, weight double")
    got = mixing.interleave(items, "corpus", "pos", w, 1)
    assert got.agg(F.countDistinct("mix_position")).first()[0] == 20_000


def test_deep_and_wide_trees(spark):
    """A chain of 300 turns, many small trees, an orphan, a root alone."""
    chain = [("deep", i, i - 1 if i else None, 0, "user", f"t{i}") for i in range(300)]
    odd = [("odd", 0, None, 0, "user", "r"), ("odd", 5, 4, 0, "user", "orphan"), ("alone", 0, None, 0, "user", "x")]
    e = spark.createDataFrame(chain + odd, "tree_id string, node_id long, parent_id long, ordinal long, role string, text string")
    got = {r.id: r.chat for r in chat.tree_paths(spark, e).collect()}
    assert set(got) == {"deep/0"}
    assert [t["content"] for t in got["deep/0"]] == [f"t{i}" for i in range(300)]


def test_a_million_nodes(spark):
    n = 600_000
    e = spark.range(2 * n).select(F.expr("id div 2").alias("tree_id"), F.expr("id % 2").alias("node_id"),
                                  F.expr("CASE WHEN id % 2 = 1 THEN 0L END").alias("parent_id"), F.lit(0).alias("ordinal"),
                                  F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    assert chat.tree_paths(spark, e).count() == n


def test_cycles_raise(spark):
    e = spark.createDataFrame([("c", 1, 2, 0, "u", "x"), ("c", 2, 1, 0, "u", "y"), ("c", 3, 1, 0, "u", "z")],
                              "tree_id string, node_id long, parent_id long, ordinal long, role string, text string")
    with pytest.raises(ValueError, match="cycle"):
        chat.tree_paths(spark, e).collect()


def test_nested_json_of_any_depth(spark):
    node = None
    for i in reversed(range(70)):
        node = {"role": "user", "text": f"t{i}", "replies": [node] if node else []}
    df = spark.createDataFrame([("x", json.dumps(node))], "id string, prompt string")
    edges = chat.nested_tree_edges(df)
    assert edges.count() == 70
    (row,) = chat.tree_paths(spark, edges).collect()
    assert len(row.chat) == 70


def test_broken_raw_files_fail(spark):
    root = scratch_path(spark, "t-broken")
    os.makedirs(f"{root}/tar")
    os.makedirs(f"{root}/array")
    with tarfile.open(f"{root}/tar/x.jsonl.tar.gz", "w:gz") as tar:
        data = b'{"v": 1}\n{broken\n'
        info = tarfile.TarInfo("a.jsonl")
        info.size = len(data)
        tar.addfile(info, io.BytesIO(data))
    with open(f"{root}/array/a.json", "w") as f:
        f.write('[{"v": 1}]')
    with open(f"{root}/array/b.json", "w") as f:
        f.write('{"not": "an array"')
    with pytest.raises(Exception):
        readers.read_tar(spark, f"{root}/tar", "v long").collect()
    with pytest.raises(Exception, match="not a JSON array"):
        readers.read_json_positions(spark, f"{root}/array", "v long").collect()
    assert [r.v for r in readers.read_json_positions(spark, f"{root}/array", "v long", skip_bad=True).collect()] == [1]


def test_pretokenize_waves(spark):
    """Two waves add up, a file without rows is marked (Spark does not list
    files of no bytes), a third run finds nothing, and a run whose record
    was lost gives the same files again."""
    root, out = scratch_path(spark, "t-raw"), scratch_path(spark, "t-out")
    os.makedirs(root)

    def put(name, texts):
        with open(f"{root}/{name}", "w") as f:
            f.writelines(json.dumps({"text": t}) + "\n" for t in texts)

    spec = packing.PackSpec(context=8, file_tokens=50, shards=2)
    run = lambda: pretokenize(spark, root, "jsonl", out, "corpus", spec, schema="text string")
    total = lambda: sinks.shard_headers(spark, out).agg(F.sum("num_tokens")).first()[0]
    put("a.jsonl", ["x" * 30] * 5)
    with open(f"{root}/empty.jsonl", "w") as f:
        f.write("\n")
    run()
    assert total() == 155
    assert sinks.read_manifest(spark, f"{out}/_manifest/inputs").count() == 2
    put("b.jsonl", ["y" * 10] * 8)
    run()
    assert total() == 155 + 88
    assert run().count() == 0 and total() == 243
    before = {f: os.path.getsize(f"{out}/{f}") for f in os.listdir(out) if f.endswith(".data")}
    for part in ("inputs", "outputs"):  # as if the second run had failed before its record
        last = max(os.listdir(f"{out}/_manifest/{part}"), key=lambda d: int(d.split("=")[1]))
        for f in os.listdir(f"{out}/_manifest/{part}/{last}"):
            os.remove(f"{out}/_manifest/{part}/{last}/{f}")
    run()
    assert {f: os.path.getsize(f"{out}/{f}") for f in os.listdir(out) if f.endswith(".data")} == before and total() == 243


def test_manifest_batches_replace(spark):
    path = scratch_path(spark, "t-manifest")
    df = spark.createDataFrame([("a",), ("b",)], "path string")
    for _ in range(2):
        sinks.append_manifest(df, path, batch="7")
    assert sinks.read_manifest(spark, path).count() == 2


def test_chat_files_are_named_and_spread(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("id"), F.lit("t" * 100).alias("text"),
                                  F.array(F.struct(F.lit("user").alias("role"), F.lit("c").alias("content"))).alias("chat"),
                                  F.lit("Some_Set").alias("dataset_name"))
    out = scratch_path(spark, "t-names")
    back = sinks.write_chat(df, out, max_file_bytes=100_000)
    files = sorted(f for f in os.listdir(out) if f.endswith(".parquet"))
    assert len(files) > 5 and files[0] == "000_Some_Set_00000.parquet"
    assert back.filter("dataset_name = 'Some_Set'").count() == 5000
