from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from shardwright.llm import decontaminate, jaccard_join, quality
from shardwright.session import materialize

from test_copies import near_by_hand, rows_of
from test_pages_and_packs import check_packing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's written output over the small table plus awkward rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(3).select("doc_id", "text", "lang", F.lit(None).cast("string").alias("source"), F.lit(None).cast("bigint").alias("n_chars"))
    odd = odd.unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("bigint")).withColumn("text", F.lit(None).cast("string")))
    out = [docs.unionByName(odd)]
    for name, f in cp.STAGES:
        out.append(materialize(spark, f(spark, out[-1], SF), name))
    return out


def test_columns(stages):
    for s in stages[1:-1]:
        assert s.dtypes == stages[0].dtypes


def test_quality_stage(spark, stages):
    kept = {r.doc_id for r in quality.weigh(stages[0], spark.read.parquet(f"{SF}/labels.parquet")).filter("log_weight < -1.5").collect()}
    want = [r for r in stages[0].collect() if r.doc_id not in kept]
    assert Counter(map(str, want)) == Counter(map(str, stages[1].collect()))


def test_exact_stage(stages):
    rows = stages[1].collect()
    top = {}
    for r in rows:
        t = r.text or ""
        top[t] = max(top.get(t, (False, 0)), (r.doc_id is not None, r.doc_id or 0))
    want = [r for r in rows if top[r.text or ""] == (r.doc_id is not None, r.doc_id or 0)]
    assert Counter(map(str, want)) == Counter(map(str, stages[2].collect()))


def test_near_stage(stages):
    texts = [(r.doc_id, r.text) for r in stages[2].collect()]
    assert rows_of(jaccard_join.find_near(stages[2])) == near_by_hand(texts, 5, 80, 100)
    low = {k: c for k, _, c in near_by_hand(texts, 5, 80, 100)}
    assert sorted(map(str, (i for i, _ in texts if low[i] == i))) == sorted(str(r.doc_id) for r in stages[3].collect())


def test_leak_stage(spark, stages):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = {r.doc_id for r in stages[3].collect()} - {r.doc_id for r in stages[4].collect()}
    leaky = {r.doc_id for r in stages[3].collect() if any(i in (r.text or "") for i in items)}
    assert leaky <= gone and len(gone) < 0.2 * stages[3].count()
    assert decontaminate.find_leaks(stages[4], spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0


def test_pack_stage(stages):
    n, least = check_packing(stages[5].collect(), [(r.doc_id, r.text) for r in stages[4].collect()], 1024)
    assert n <= 1.02 * least + 2


def test_run(spark, stages):
    assert cp.ORACLE_SQL is None and 4 <= len(cp.STAGES) <= 5
    assert cp.run(spark, SF).columns == stages[-1].columns
