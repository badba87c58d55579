"""Two-level running aggregates equal plain windows, also on a skewed key."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from shardwright.operators.ordering import bucket_numeric, ordinal, running, running_sum


def _skewed(spark):
    # key 'hot' holds a third of the rows
    return spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 17).cast("string")).alias("k"),
        F.col("id").alias("o"), ((F.col("id") * 7919) % 101).alias("v"))


def test_running_matches_plain_window(spark):
    df = _skewed(spark)
    w = Window.partitionBy("k").orderBy("o")
    plain = df.select("k", "o",
                      (F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("v")).alias("s"),
                      F.min("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("mn"),
                      F.max("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("mx"),
                      (F.row_number().over(w) - 1).alias("rn"))
    b = bucket_numeric("o", 100)
    x = running_sum(df, "v", ["o"], by=["k"], bucket=b, out="s")
    x = running(x, "v", "min", ["o"], by=["k"], bucket=b, out="mn", inclusive=False)
    x = running(x, "v", "max", ["o"], by=["k"], bucket=b, out="mx")
    x = ordinal(x, ["o"], by=["k"], bucket=b, out="rn")
    got = x.select("k", "o", "s", "mn", "mx", "rn")
    assert got.count() == 3000
    assert got.exceptAll(plain).count() == 0 and plain.exceptAll(got).count() == 0


def test_global_ordinal_without_single_partition_window(spark):
    df = _skewed(spark)
    x = ordinal(df, ["o"], bucket=bucket_numeric("o", 250), out="rn")
    assert sorted(r[0] - r[1] for r in x.select("o", "rn").collect()) == [0] * 3000
    # the big table is windowed by bucket; only the bucket table has a global window
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "__bucket" in plan


def test_adaptive_bucket_sparse_keys(spark):
    from shardwright.operators.ordering import with_adaptive_bucket
    df = spark.range(5000).select((F.col("id") % 2).alias("k"), (F.col("id") * 1_000_000_000_000).alias("o"))
    b = with_adaptive_bucket(df, "o", ["k"], 100, out="b")
    per = {r["k"]: r["n"] for r in b.groupBy("k").agg(F.count_distinct("b").alias("n")).collect()}
    assert all(20 <= n <= 30 for n in per.values())   # ~2500 rows / 100 per bucket, not one per row
    # the bucket is non-decreasing in the key inside each group
    w = Window.partitionBy("k").orderBy("o")
    assert b.withColumn("prev", F.lag("b").over(w)).filter(F.col("prev") > F.col("b")).count() == 0


def test_packing_with_sparse_order_equals_dense(spark):
    from shardwright.operators import packing
    from sf_paths import SF_SMALL
    from shardwright.plans import packing_plans as pp
    tok = pp.tokenized(spark, SF_SMALL)
    spec = packing.PackSpec(context=512, file_tokens=5000, shards=4, bucket_rows=8)
    sparse_spec = packing.PackSpec(context=512, file_tokens=5000, shards=4, bucket_rows=8, dense_order=False)
    dense = packing.pack_windows(tok, spec, pp.BY, "doc_id").select(
        *pp.BY, "file_no", "win", F.md5(F.array_join("input_ids", ",")).alias("h"))
    sparse_tok = tok.withColumn("o", F.col("doc_id") * 1_000_000_000_000 + 7)
    sparse = packing.pack_windows(sparse_tok, sparse_spec, pp.BY, "o").select(
        *pp.BY, "file_no", "win", F.md5(F.array_join("input_ids", ",")).alias("h"))
    assert dense.count() == sparse.count() > 0
    assert dense.exceptAll(sparse).count() == 0
