"""Readers over many small files."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from shardwright.sources import readers


def test_whole_text_reads_many_small_files_per_task(spark, tmp_path):
    """32 files a task, whatever their size, made tens of thousands of tasks."""
    for i in range(600):
        folder = tmp_path / str(i % 7)
        folder.mkdir(exist_ok=True)
        (folder / f"doc-{i}.txt").write_text(f"text é {i}\n", encoding="utf-8")
    t = readers.read_whole_text(spark, str(tmp_path), pattern=readers.glob_filter("text"))
    assert t.rdd.getNumPartitions() < 600 / 32
    got = {(os.path.basename(r.file_path), r.text) for r in t.collect()}
    assert got == {(f"doc-{i}.txt", f"text é {i}\n") for i in range(600)}


def test_whole_text_keeps_the_callers_session_and_unpacks_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xff plain\r\n")
    (tmp_path / "b.txt.gz").write_bytes(gzip.compress(b"packed"))
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    plain = readers.read_whole_text(spark, str(tmp_path), pattern="*.txt", pretty=False)
    assert [bytes(r.b) for r in plain.select(F.col("text").cast("binary").alias("b")).collect()] == [b"\xff plain\r\n"]
    some = readers.read_whole_text(spark, str(tmp_path), pretty=False)
    assert "packed" in {r.text for r in some.collect()}
    some.createOrReplaceTempView("whole_text_rows")
    assert spark.sql("SELECT count(*) AS n FROM whole_text_rows").first().n == 2
    assert spark.conf.get("spark.sql.files.openCostInBytes") == cost


def test_whole_text_lists_files_by_tasks(spark, tmp_path):
    """the driver held the status of every file."""
    names = ["a b.txt", "per%20cent.txt", "ü#?[1].txt", "sub/deep/x.json", "sub/_k=1/y.xml", "no\u00a0break.txt", "q\"{}^`|<>.txt", "empty.txt"]
    for n in [*names, "_hidden.txt", ".dot.txt", "_dir/z.txt", "sub/.d/z.txt", "other.csv", "part.txt._COPYING_"]:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(b"" if n == "empty.txt" else n.encode())
    pattern, root = readers.glob_filter("text"), str(tmp_path)
    t = readers.read_whole_text(spark, root, pattern=pattern, pretty=False)
    assert t.inputFiles() and not any(f.endswith(".txt") for f in t.inputFiles())   # the listing's files, not the corpus
    got = {r.file_path: r.text for r in t.collect()}
    assert sorted(got.values()) == sorted(["", *(n for n in names if n != "empty.txt")])
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).format("binaryFile").load(root)
    want = {r.p: bytes(r.content).decode() for r in files.select(F.col("_metadata.file_path").alias("p"), "content").collect()}
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
    (one,) = readers.read_whole_text(spark, str(tmp_path / "a b.txt"), pattern="*.txt", pretty=False).collect()
    assert one.text == "a b.txt"
    two = readers.read_whole_text(spark, [str(tmp_path / "sub"), f"file:{tmp_path}/_dir"], pattern=pattern, pretty=False)
    assert sorted(r.text for r in two.collect()) == ["_dir/z.txt", "sub/_k=1/y.xml", "sub/deep/x.json"]
    none = tmp_path / "none"
    none.mkdir()
    assert readers.read_whole_text(spark, str(none), pattern=pattern).collect() == []


def test_whole_text_of_a_missing_folder_or_file_fails(spark, tmp_path):
    pattern = readers.glob_filter("text")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.read_whole_text(spark, str(tmp_path / "gone"), pattern=pattern).collect()
    for n in "ab":
        (tmp_path / f"{n}.txt").write_text(n)
    t = readers.read_whole_text(spark, str(tmp_path), pattern=pattern)
    (tmp_path / "b.txt").unlink()
    with pytest.raises(Exception, match="b.txt"):
        t.collect()
    setting = "spark.sql.files.ignoreMissingFiles"
    spark.conf.set(setting, "true")
    try:
        (tmp_path / "b.txt").write_text("b")
        t = readers.read_whole_text(spark, str(tmp_path), pattern=pattern)
        (tmp_path / "b.txt").unlink()
        assert [r.text for r in t.collect()] == ["a"]
    finally:
        spark.conf.unset(setting)
