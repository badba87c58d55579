"""Invariants of the token pipeline, splits and mixing, and plan shape."""

import json
import os
import tarfile
import io

from pyspark.sql import functions as F

import __spark_entry__ as entry
from sf_paths import SF_CHECK, SF_SMALL
from shardwright.operators import mixing, packing
from shardwright.plans import packing_plans as pp
from shardwright.session import scratch_path
from shardwright.sources import readers


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert set(df.columns) >= {"source", "shard", "file_no", "win", "ids_md5"}


def test_every_query_has_a_name_and_sql_names_exist():
    q, s = entry.queries(), entry.oracle_sql()
    assert len(q) >= 70
    assert set(s) <= set(q)


def test_tokens_in_equal_windows_plus_tails(spark):
    tok = pp.tokenized(spark, SF_CHECK)
    total = tok.agg(F.sum("n_tokens")).first()[0]
    stats = pp.stats(spark, SF_CHECK)
    assert stats.agg(F.sum("num_tokens")).first()[0] == total
    w = packing.pack_windows(tok, pp.SPEC, pp.BY, "doc_id")
    n_win = w.count()
    C, M = pp.SPEC.context, pp.SPEC.file_tokens
    expect = stats.agg(F.sum(F.floor(F.col("num_tokens") / C))).first()[0]
    assert n_win == expect
    assert w.filter(F.size("input_ids") != C).count() == 0
    assert M // C * C < M   # the shard files here do have per-file tails


def test_mix_is_a_permutation_and_follows_weights(spark):
    items = spark.range(3000).select(
        F.when(F.col("id") < 2000, F.lit("a")).otherwise(F.lit("b")).alias("corpus"),
        F.when(F.col("id") < 2000, F.col("id")).otherwise(F.col("id") - 2000).alias("position"))
    w = spark.createDataFrame([("a", 2 / 3), ("b", 1 / 3)], "corpus string, weight double")
    m = mixing.interleave(items, "corpus", "position", w, 7)
    rows = m.select("corpus", "position", "mix_position").collect()
    assert sorted(r["mix_position"] for r in rows) == list(range(3000))
    by_pos = sorted(rows, key=lambda r: r["mix_position"])
    # order inside a corpus is kept
    for c in "ab":
        ps = [r["position"] for r in by_pos if r["corpus"] == c]
        assert ps == sorted(ps)
    share = sum(1 for r in by_pos[:1500] if r["corpus"] == "a") / 1500
    assert 0.6 < share < 0.73


def test_split_is_a_partition(spark):
    q = entry.queries()["split_rate"](spark, SF_SMALL)
    assert q.count() == q.select("file_name").distinct().count()
    assert set(r[0] for r in q.select("split").distinct().collect()) == {"train", "validation"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_packing_plan_has_no_single_partition_exchange_on_documents(spark):
    w = entry.queries()["pack_windows"](spark, SF_SMALL)
    plan = w._jdf.queryExecution().optimizedPlan().toString()
    phys = _plan(w)
    assert "SinglePartition" not in phys
    assert "Window" in plan


def test_scan_prunes_and_pushes(spark):
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet").where("lang = 'en'").select("text")
    phys = _plan(d)
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in phys
    assert "ReadSchema: struct<text:string,lang:string>" in phys


def test_json_pretty_print_and_bad_arrays(spark):
    root = scratch_path(spark, "t-text")
    os.makedirs(root)
    with open(f"{root}/a.json", "w") as f:
        f.write('{"b": [1, 2], "a": "é"}')
    with open(f"{root}/b.xml", "w") as f:
        f.write("<r><x>1</x></r>")
    with open(f"{root}/c.txt", "w") as f:
        f.write("plain {text")
    got = {os.path.basename(r["file_path"]): r["text"] for r in readers.read_whole_text(spark, root).collect()}
    assert got["a.json"] == json.dumps({"b": [1, 2], "a": "é"}, indent=4)
    assert "<x>1</x>" in got["b.xml"] and got["b.xml"] != "<r><x>1</x></r>"
    assert got["c.txt"] == "plain {text"
    bad = readers.bad_json_files(spark, root, pattern="*.txt").collect()
    assert len(bad) == 1


def test_tar_skips_other_members(spark):
    root = scratch_path(spark, "t-tar")
    os.makedirs(root)
    with tarfile.open(f"{root}/x.jsonl.tar.gz", "w:gz") as tar:
        for name, data in (("a.jsonl", b'{"v": 1}\n{"v": 2}\n'), ("b.json", b'[{"v": 3}]'), ("c.jsonl", b'{"v": 4}\n')):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    got = sorted(r["v"] for r in readers.read_tar(spark, root, "v long").collect())
    assert got == [1, 2, 4]
    arr = sorted(r["v"] for r in readers.read_tar(spark, root, "v long", member_suffix=".json", as_array=True).collect())
    assert arr == [3]


def test_glob_filter():
    assert readers.glob_filter("parquet") == "*.parquet"
    assert readers.glob_filter("text") == "{*.txt,*.json,*.xml}"
    try:
        readers.glob_filter("csv")
        raise AssertionError("unknown format must raise")
    except ValueError:
        pass


def test_content_only_reader_prunes_to_one_column(spark):
    from shardwright.operators import registry
    out = scratch_path(spark, "t-prune")
    spark.read.parquet(f"{SF_SMALL}/documents.parquet").withColumnRenamed("text", "content").write.parquet(out)
    df = registry.read_corpus(spark, "StarCoderData", out)
    phys = _plan(df)
    assert "ReadSchema: struct<content:string>" in phys
    assert df.columns == ["text"] and df.count() == spark.read.parquet(out).count()
