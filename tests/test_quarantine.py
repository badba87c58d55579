"""Broken inputs and repeated runs: nothing is lost, nothing is counted twice."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shardwright.operators import chat, documents, packing, pretokenize
from shardwright.sources import readers, sinks


def test_broken_json_array_fails(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps([{"a": 1}, {"a": 2}]))
    assert sorted(r.a for r in readers.read_json_array(spark, str(tmp_path), "a int").collect()) == [1, 2]
    (tmp_path / "bad.json").write_text('[{"a": 3}, {"a"')
    with pytest.raises(Exception):
        readers.read_json_array(spark, str(tmp_path), "a int").collect()
    with pytest.raises(Exception):
        readers.read_format(spark, str(tmp_path), "json", "a int").collect()
    assert [r.file_path.rsplit("/", 1)[1] for r in readers.bad_json_files(spark, str(tmp_path)).collect()] == ["bad.json"]


def test_broken_metadata_is_kept_as_text(spark):
    rows = [("1", "x", "{broken", "s1"), ("2", "x", ' {"k": 1, "n": {"m": 2}}', "s2"), ("3", "x", "plain", "s3"), ("4", "x", None, "s4")]
    df = spark.createDataFrame(rows, "id string, text string, metadata string, source string")
    got = {r.id: r.metadata for r in documents.adapt(df).collect()}
    assert got["1"] == {"metadata": "{broken", "source": "s1"} and got["2"] == {"k": "1", "n": '{"m":2}', "source": "s2"}
    assert got["3"] == {"metadata": "plain", "source": "s3"} and got["4"] == {"source": "s4"}


def test_a_wave_without_rows_is_remembered(spark, tmp_path):
    raw, out = tmp_path / "raw", str(tmp_path / "out")
    raw.mkdir()
    spec = packing.PackSpec(context=8, file_tokens=64, shards=2)
    run = lambda: pretokenize.pretokenize(spark, str(raw), "jsonl", out, "c", spec, schema="text string",
                                          fn=lambda d: d.filter("text != 'drop'")).collect()
    (raw / "a.jsonl").write_text('{"text": "drop"}\n')
    assert run() == []
    (raw / "b.jsonl").write_text('{"text": "kept words"}\n')
    assert len(run()) == 1
    done = {r.path.rsplit("/", 1)[1] for r in sinks.read_manifest(spark, f"{out}/_manifest/inputs").collect()}
    assert done == {"a.jsonl", "b.jsonl"} and run() == []


def test_outputs_without_inputs_are_written_again(spark, tmp_path):
    """A run that failed between its two records: its numbers are used again."""
    raw, out = tmp_path / "raw", tmp_path / "out"
    raw.mkdir()
    (raw / "a.jsonl").write_text('{"text": "some words"}\n')
    spec = packing.PackSpec(context=8, file_tokens=64, shards=1)
    run = lambda: [r.file_name for r in pretokenize.pretokenize(spark, str(raw), "jsonl", str(out), "c", spec, schema="text string").collect()]
    first = run()
    (path,) = (out / "_manifest" / "inputs").glob("batch=*")
    for f in path.rglob("*"):
        f.unlink()
    path.rmdir()
    assert run() == first
    (raw / "b.jsonl").write_text('{"text": "more words"}\n')
    assert run() == ["c-000-00001.data"]


def test_a_repeated_epoch_adds_nothing(spark, tmp_path):
    files = spark.createDataFrame([("f1",), ("f2",)], "path string")
    for _ in range(2):
        sinks.append_manifest(files, str(tmp_path / "m"), batch="epoch-0")
    assert sinks.read_manifest(spark, str(tmp_path / "m")).count() == 2


def test_nested_trees_are_walked_once(spark):
    tree = {"role": "user", "text": "a", "replies": [{"role": "assistant", "text": "b"}, None, {"role": "assistant", "text": 5, "replies": [{"role": "user", "text": "d", "replies": []}]}]}
    df = spark.createDataFrame([(1, json.dumps(tree)), (2, None)], "id int, prompt string")
    got = [tuple(r) for r in chat.nested_tree_edges(df).orderBy("tree_id", "node_id").collect()]
    assert got == [("1", "0", None, 0, "user", "a"), ("1", "1", "0", 0, "assistant", "b"), ("1", "2", "0", 2, "assistant", "5"),
                   ("1", "3", "2", 0, "user", "d"), ("2", "0", None, 0, None, None)]
    for bad in ("{", '{"replies": 3}', "[1]", '{"replies": [7]}'):
        with pytest.raises(Exception, match="not a JSON tree"):
            chat.nested_tree_edges(spark.createDataFrame([(1, bad)], "id int, prompt string")).collect()


def test_a_large_tree_is_numbered_in_many_tasks(spark):
    """A root with 20,000 replies: places in depth-first order, spread."""
    n = 20_000
    e = spark.range(n + 1).select(F.lit("t").alias("tree_id"), F.col("id").alias("node_id"), F.when(F.col("id") > 0, F.lit(0)).cast("bigint").alias("parent_id"),
                                  (F.lit(n) - F.col("id")).alias("ordinal"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions stay apart
    try:
        out = chat.tree_paths(spark, e).withColumn("task", F.spark_partition_id())
        rows = out.select(F.split("id", "/")[1].cast("int").alias("k"), F.col("chat")[1]["content"].cast("int").alias("leaf"), "task").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(r.k for r in rows) == list(range(n)) and all(r.k == n - r.leaf for r in rows)
    per_task = Counter(r.task for r in rows)
    assert len(per_task) > 2 and max(per_task.values()) < n * 0.6
