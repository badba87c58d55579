"""Packing of texts: what its shuffles carry."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from shardwright.operators import ordering, packing
from sf_paths import SF_SMALL


@pytest.mark.parametrize("query", ["pack_text", "pack_text_epochs"])
def test_ids_are_made_after_the_offsets(spark, query):
    """the offset step shuffled four bytes a token, and the text twice more."""
    plan = entry.queries()[query](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Window")
    assert "smallint" in plan


def test_text_gives_the_pieces_of_its_ids(spark):
    rows = [(i, "ab<|im_end|>é" * (i % 5)) for i in range(40)]
    df = packing.tokenize(spark.createDataFrame(rows, "k long, text string").withColumn("s", F.col("k") % 2), "text")
    spec = packing.PackSpec(context=16, file_tokens=64, shards=1)
    a = packing.window_pieces(df.drop("text"), spec, ["s"], "k")
    b = packing.window_pieces(df.drop("ids"), spec, ["s"], "k", text="text")
    assert a.count() == b.count() > 40 and a.exceptAll(b).isEmpty()


def test_narrow_ids_lose_nothing(spark):
    ids = [[], [0, 32767], [32768], [1, 2**31 - 1], [-5, 7], None, [1, None]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "i int, ids array<int>")
    n = df.select("i", packing.narrow_ids().alias("n"))
    assert [r.x for r in n.select("i", packing.full_ids(F.col("n")).alias("x")).orderBy("i").collect()] == ids
    assert [r.i for r in n.filter("n.wide IS NOT NULL").orderBy("i").collect()] == [2, 3]


def test_counts_by_group_do_not_move_the_rows(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") % 3 > 0, F.col("id") % 3))
    out = ordering.count_by(df, ["g"])
    assert {(r.g, r.n) for r in out.select("g", "n").distinct().collect()} == {(None, 334), (1, 333), (2, 333)}
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
