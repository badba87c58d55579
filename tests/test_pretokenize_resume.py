"""The tokenize job in waves: a failed run between two that finish, and what
a run leaves on disk."""

import glob
import json
import os
import time

import duckdb
from pyspark.sql import functions as F
from sf_paths import SF_SMALL

from shardwright.operators import packing
from shardwright.operators import pretokenize as job
from shardwright.plans import source_plans
from shardwright.plans.registry import ORACLE
from shardwright.session import REMOVE_SHUFFLES, scratch_path
from shardwright.sources import sinks


def _expected():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_SMALL}/documents.parquet'")
    return set(con.execute(ORACLE["pretokenize_resume"]).fetchall())


def test_a_failed_run_leaves_files_behind(spark, monkeypatch):
    """the query names a failed run, but ran none."""
    real, seen = job.pretokenize, []

    def watched(spark, root, fmt, out, *args, **more):
        def state():
            files = {f: os.stat(f"{out}/{f}").st_mtime_ns for f in os.listdir(out) if f.endswith(".data")} if os.path.isdir(out) else {}
            return files, sinks.read_manifest(spark, f"{out}/_manifest/inputs").count()
        before, ended = state(), "failed"
        try:
            done = real(spark, root, fmt, out, *args, **more)
            ended = "finished"
            return done
        finally:
            seen.append((ended, before, state()))

    monkeypatch.setattr(job, "pretokenize", watched)
    got = {tuple(r) for r in source_plans.q_pretokenize_resume(spark, SF_SMALL).collect()}
    assert [ended for ended, _, _ in seen] == ["finished", "failed", "finished"]
    (first, recorded), (left, still) = seen[1][1:]
    assert set(first) < set(left) and still == recorded          # files of the failed run, no record of it
    last, all_recorded = seen[2][2]
    assert set(last) == set(left) and all_recorded > recorded
    assert all(last[f] > left[f] for f in set(left) - set(first)) and all(last[f] == left[f] for f in first)
    assert got == _expected()


def test_a_run_that_is_not_accepted_is_not_recorded(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.jsonl").write_text('{"text": "some words"}\n')
    out, offered = str(tmp_path / "out"), []
    spec = job.packing.PackSpec(context=8, file_tokens=64, shards=1)
    run = lambda **more: job.pretokenize(spark, str(tmp_path / "raw"), "jsonl", out, "c", spec, schema="text string", **more).collect()

    def refuse(written):
        offered.extend(written.collect())
        raise RuntimeError("not accepted")

    try:
        run(accept=refuse)
    except RuntimeError:
        pass
    assert sinks.read_manifest(spark, f"{out}/_manifest/inputs").isEmpty()
    assert run() == offered and run() == []
    assert sinks.shard_headers(spark, out).agg(F.sum("num_tokens")).first()[0] == 11


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in (files.apply(i).getPath() for i in range(files.size())) if "/shuffle_" in f}


def test_a_run_leaves_nothing_but_its_files(spark, tmp_path):
    """shuffle files of every step and the token ids of every run stayed."""
    (tmp_path / "raw").mkdir()
    for k in range(3):
        (tmp_path / "raw" / f"{k}.jsonl").write_text("".join(json.dumps({"text": f"{k} words {i}"}) + "\n" for i in range(200)))
    tables = lambda: set(glob.glob(f"{os.path.dirname(scratch_path(spark, 'x')).removeprefix('file:')}/pretokenized-*"))
    setting, kept, shuffles = spark.conf.get(REMOVE_SHUFFLES, None), tables(), _shuffle_files(spark)

    def refuse(written):
        assert tables() == kept
        raise RuntimeError("not accepted")

    for accept in (refuse, None):
        try:
            job.pretokenize(spark, str(tmp_path / "raw"), "jsonl", str(tmp_path / "out"), "c", packing.PackSpec(file_tokens=500, shards=2),
                            schema="text string", accept=accept)
        except RuntimeError:
            pass
        until = time.time() + 20  # they are removed in the background
        while (left := _shuffle_files(spark) - shuffles) and time.time() < until:
            time.sleep(0.2)
        assert not left and tables() == kept and spark.conf.get(REMOVE_SHUFFLES, None) == setting


def test_ids_of_more_than_16_bits_are_exported(spark, tmp_path):
    docs = [[1, 2, 3], [40_000, 1], [70_000] * 7, [], [32_767], [32_768, 5], [0], list(range(32_760, 32_776))]
    rows = [("c", 0, i, ids, len(ids)) for i, ids in enumerate(docs)]
    tok = spark.createDataFrame(rows, "source string, shard int, doc_id long, ids array<int>, n_tokens long")
    spec = packing.PackSpec(context=4, file_tokens=5, shards=1)
    pieces = packing.pack_shards(tok, spec, ["source", "shard"], "doc_id", narrow=True)
    assert dict(pieces.dtypes)["ids"] == "array<int>"
    written = sinks.export_shards(pieces, str(tmp_path), narrow=True)
    assert "array<smallint>" in written._jdf.queryExecution().analyzed().toString().replace("ARRAY<SMALLINT>", "array<smallint>")
    assert written.count() == 7
    chunks = sorted(sinks.import_shards(spark, str(tmp_path), 100).collect(), key=lambda r: r.path)
    assert [i for r in chunks for i in r.ids] == [i for ids in docs for i in ids]
