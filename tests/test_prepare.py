"""End-to-end chat preparation from raw files, format dispatch, streaming."""

import json
import os

from pyspark.sql import functions as F

import __spark_entry__ as entry
from sf_paths import SF_SMALL
from shardwright.operators import registry, splits
from shardwright.session import scratch_path
from shardwright.sources import readers


def test_prepare_chat_jsonl_default_ids(spark):
    root = scratch_path(spark, "t-chat")
    os.makedirs(root)
    with open(f"{root}/a.jsonl", "w") as f:
        f.write(json.dumps({"instruction": "do", "input": "", "output": "done"}) + "\n")
        f.write(json.dumps({"instruction": "", "input": "x", "output": "y"}) + "\n")
    out = registry.prepare_chat(spark, "COIG-CQIA", root).orderBy("id").collect()
    assert [r["id"].rsplit("/", 1)[1] for r in out] == ["0", "1"]
    assert [[m["role"] for m in r["chat"]] for r in out] == [["instruction", "assistant"], ["user", "assistant"]]
    assert out[0]["text"] == "<|im_start|>instruction:\n do<|im_end|>\n<|im_start|>assistant:\n done<|im_end|>\n"


def test_prepare_chat_nested_tree(spark):
    root = scratch_path(spark, "t-tree")
    os.makedirs(root)
    tree = {"role": "prompter", "text": "A", "replies": [
        {"role": "assistant", "text": "B", "replies": []},
        {"role": "assistant", "text": "C", "replies": [{"role": "prompter", "text": "D", "replies": []}]}]}
    with open(f"{root}/t.jsonl", "w") as f:
        f.write(json.dumps({"id": "t", "prompt": tree}) + "\n")
        f.write(json.dumps({"id": "u", "prompt": {"role": "prompter", "text": "alone", "replies": []}}) + "\n")
    out = {r["id"]: [m["content"] for m in r["chat"]] for r in registry.prepare_chat(spark, "oasst2", root).collect()}
    assert out == {"t/0": ["A", "B"], "t/1": ["A", "C", "D"]}


def test_read_format_dispatch(spark):
    root = scratch_path(spark, "t-fmt")
    spark.read.parquet(f"{SF_SMALL}/labels.parquet").write.json(f"{root}/j")
    df = readers.read_format(spark, f"{root}/j", "jsonl", schema="doc_id long, quality int",
                             fn=lambda d: d.withColumn("q2", F.col("quality") * 2), where="quality = 1")
    n = spark.read.parquet(f"{SF_SMALL}/labels.parquet").filter("quality = 1").count()
    assert df.count() == n and "q2" in df.columns


def test_choose_split_routes(spark):
    f = spark.createDataFrame([(f"c-00{i}",) for i in range(10)], "file_name string")
    assert splits.choose_split(f, 1, validation_rate=0.1).filter("split = 'validation'").count() == 1
    g = spark.createDataFrame([("x/train/a.data",), ("x/validation/b.data",)], "file_name string")
    got = {r["file_name"]: r["split"] for r in splits.choose_split(g, 1, folder_split=True).collect()}
    assert got == {"x/train/a.data": "train", "x/validation/b.data": "validation"}


def test_streams_equal_batch(spark):
    q = entry.queries()
    a = q["stream_plateau"](spark, SF_SMALL).exceptAll(q["plateau_alert"](spark, SF_SMALL))
    assert a.count() == 0
    assert q["stream_plateau"](spark, SF_SMALL).count() == q["plateau_alert"](spark, SF_SMALL).count()


def test_jsonl_bad_line_and_gzip(spark):
    import gzip
    root = scratch_path(spark, "t-bad-jsonl")
    os.makedirs(root)
    with gzip.open(f"{root}/a.jsonl.gz", "wt") as f:
        f.write('{"v": 1}\n{"v": 2}\n')
    with open(f"{root}/b.jsonl", "w") as f:
        f.write('{"v": 3}\n{not json\n')
    try:
        readers.read_jsonl(spark, root, "v long", pattern="*.jsonl*").collect()
        raise AssertionError("a bad line must fail the read")
    except Exception as e:  # noqa: BLE001
        assert "AssertionError" not in type(e).__name__
    ok = readers.read_jsonl(spark, root, "v long, _corrupt_record string", pattern="*.jsonl*", mode="PERMISSIVE")
    rows = ok.collect()
    assert sorted(r["v"] for r in rows if r["v"] is not None) == [1, 2, 3]
    assert [r["_corrupt_record"] for r in rows if r["_corrupt_record"]] == ["{not json"]
