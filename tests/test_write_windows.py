"""The written, one-shuffle window sink equals pack_windows, also when many
windows are cut by bucket boundaries."""

from pyspark.sql import functions as F

from sf_paths import SF_CHECK
from shardwright.operators import packing
from shardwright.plans import packing_plans as pp
from shardwright.session import scratch_path


def _norm(df):
    return df.select(*pp.BY, "file_no", "win", "n_pieces", "first_doc_id", "last_doc_id",
                     F.md5(F.array_join("input_ids", ",")).alias("h"))


def test_write_windows_equals_pack_windows(spark):
    tok = pp.tokenized(spark, SF_CHECK)
    spec = packing.PackSpec(context=pp.SPEC.context, file_tokens=pp.SPEC.file_tokens, shards=pp.SPEC.shards,
                            bucket_rows=4)   # buckets of 4 documents per shard: many boundaries
    a = _norm(packing.pack_windows(tok, spec, pp.BY, "doc_id"))
    path = scratch_path(spark, "t-windows")
    b = _norm(packing.write_windows(tok, spec, pp.BY, "doc_id", path))
    assert a.count() == b.count() > 0
    assert a.exceptAll(b).count() == 0
    kinds = {r[0]: r[1] for r in spark.read.parquet(f"{path}/stage").groupBy("kind").count().collect()}
    assert kinds.get("cut", 0) > 0 and kinds.get("whole", 0) > 0
    assert spark.read.parquet(f"{path}/merged").count() > 0


def test_write_windows_job1_has_no_window_shuffle(spark):
    tok = pp.tokenized(spark, SF_CHECK)
    wp = packing.window_pieces(tok, pp.SPEC, pp.BY, "doc_id", keep_bucket=True)
    g = wp.groupBy(*pp.BY, packing.SB, "file_no", "win").agg(F.count("*"))
    plan = g._jdf.queryExecution().executedPlan().toString()
    exchanges = [ln for ln in plan.splitlines() if "Exchange hashpartitioning" in ln]
    assert not any("win" in ln for ln in exchanges)
