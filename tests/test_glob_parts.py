"""Written folders of many part files."""

import glob

import __spark_entry__ as entry
from shardwright.plans import source_plans
from sf_paths import SF_CHECK


def test_scan_glob_deals_a_large_folder_to_many_tasks(spark, tmp_path, monkeypatch):
    """a source, and a language, was written by one task."""
    data = tmp_path / "data"
    spark.read.parquet(f"{SF_CHECK}/documents.parquet").repartition(8).write.parquet(str(data / "documents.parquet"))
    roots = []
    real = source_plans.scratch_path
    monkeypatch.setattr(source_plans, "scratch_path", lambda *a: roots.append(real(*a)) or roots[-1])
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        got = {r.handler: r.n_files for r in entry.queries()["scan_glob"](spark, str(data)).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    d = spark.read.parquet(str(data / "documents.parquet"))
    assert got == {"jsonl": d.select("source").distinct().count(), "parquet": d.select("lang").distinct().count(), "text": 0}
    assert len(glob.glob(f"{roots[0]}/parquet/lang=en/*.parquet")) > 1
    back = spark.read.json(f"{roots[0]}/jsonl").select("doc_id", "text")
    assert back.exceptAll(d.select("doc_id", "text")).isEmpty() and back.count() == d.count()
