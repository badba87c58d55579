"""Running sums and ordinals that never put a whole stream in one task.

A window ``sum() over (partition by shard order by pos)`` puts a whole shard
in one task, and a global one (no ``partition by``) puts everything in one.
Here the order is cut into buckets (a coarse, monotone function of the order
key): each (partition, bucket) group gets a local running sum in its own
window task, and the bucket totals are written to the shared folder (a small
table; the input is read once more for it, and the plan that follows holds
the input once, so chained running sums grow by one step each). Their
exclusive running sums are taken the same way over groups of ``FAN`` buckets,
so the table that meets in one task per partition has one row per ``FAN``
buckets, and are joined back null-safely: null keys and null buckets are
groups like any other, first in the order. The written size and the rows of
the totals decide between a broadcast and a shuffle join: a few compressed
megabytes can hold millions of rows, too many for the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

_B = "__bucket"


def bucket_numeric(order: Column | str, width: int) -> Column:
    """Bucket of a numeric order key: ``floor(order / width)``."""
    o = F.col(order) if isinstance(order, str) else order
    return F.floor(o / F.lit(width)).cast("bigint")


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, null equal to null; the right keys are dropped."""
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(r, cond, how).drop(*[f"__r_{k}" for k in keys])


def with_adaptive_bucket(df: DataFrame, order: str, by: Sequence[str], rows_per_bucket: int,
                         out: str = "__abucket") -> DataFrame:
    """Add ``out``, a bucket of a numeric order key whose width is set per
    ``by`` group from the group's (min, max, count), so a group gets about
    ``count / rows_per_bucket`` buckets whether its keys are dense or sparse
    (e.g. hashed ids). The per-group statistics come from the key columns
    only (one small row per group) and are joined back null-safely."""
    by = list(by)
    o = F.col(order)
    stats = df.groupBy(*by).agg(F.min(o).alias("__lo"), F.max(o).alias("__hi"), F.count("*").alias("__n"))
    n_buckets = F.greatest(F.lit(1), F.ceil(F.col("__n") / F.lit(rows_per_bucket)))
    width = F.greatest(F.lit(1), F.ceil((F.col("__hi") - F.col("__lo") + 1) / n_buckets))
    stats = stats.select(*by, "__lo", width.cast("bigint").alias("__w"))
    if by:
        x = _null_safe(df, stats, by)
    else:
        x = df.withColumn("__lo", stats.select("__lo").scalar()).withColumn("__w", stats.select("__w").scalar())
    return x.withColumn(out, F.floor((o - F.col("__lo")) / F.col("__w")).cast("bigint")).drop("__lo", "__w")


def with_range_bucket(df: DataFrame, order: Sequence[str], out: str = "__rbucket", n: int | None = None) -> DataFrame:
    """Add ``out``, a bucket of an order key of any type: the partition of a
    range partitioning by it (about equal rows each, null first). Written
    to the shared folder, so that the buckets are the same at every use."""
    spark = df.sparkSession
    n = n or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return materialize(spark, df.repartitionByRange(n, *order).withColumn(out, F.spark_partition_id().cast("bigint")), "range-buckets")


def bucket_hex(order: Column | str, digits: int = 4) -> Column:
    """Bucket of a hex-string order key (e.g. an MD5 order key): its first
    ``digits`` hex digits, 16**digits buckets."""
    o = F.col(order) if isinstance(order, str) else order
    return F.conv(F.substring(o, 1, digits), 16, 10).cast("bigint")


_AGG = {"sum": F.sum, "min": F.min, "max": F.max}
FAN = 4096  # buckets per group of the second level
BROADCAST_ROWS = 1 << 17  # bucket totals that the driver may hold, whatever their written size


def _combine(how: str, before: Column, here: Column) -> Column:
    """Aggregate of two disjoint runs; null is an empty run."""
    if how == "min":
        return F.least(before, here)
    if how == "max":
        return F.greatest(before, here)
    both = F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0))
    return F.when(before.isNull() & here.isNull(), F.lit(None)).otherwise(both)


def _bases(totals: DataFrame, by: Sequence[str], how: str) -> DataFrame:
    """Exclusive running aggregate ``__base`` of the bucket totals, in two
    levels: within groups of ``FAN`` buckets, and over the groups."""
    agg = _AGG[how]
    whole = dict(totals.dtypes)[_B] in ("tinyint", "smallint", "int", "bigint")
    # buckets that are not whole numbers (a few names) form one group
    t = totals.withColumn("__c", F.floor(F.col(_B) / FAN).cast("bigint") if whole else F.lit(0).cast("bigint"))
    before = Window.partitionBy(*by, "__c").orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    inner = t.withColumn("__in", agg("__tot").over(before)).drop("__tot")
    groups = t.groupBy(*by, "__c").agg(agg("__tot").alias("__ct"))
    outer = Window.partitionBy(*by).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("__out", agg("__ct").over(outer)).drop("__ct")
    return _null_safe(inner, groups, [*by, "__c"]).select(*by, _B, _combine(how, F.col("__out"), F.col("__in")).alias("__base"))


def running(df: DataFrame, value: str | Column, how: str, order: Sequence[str], by: Sequence[str] = (),
            bucket: Column | None = None, out: str = "running", inclusive: bool = True,
            bucket_out: str | None = None) -> DataFrame:
    """Add ``out`` = running ``how`` (sum / min / max) of ``value`` in
    ``order`` within ``by``; exclusive (rows strictly before) unless
    ``inclusive``, null when no row precedes. ``bucket`` must be
    non-decreasing in ``order`` within ``by``; without it the window
    partitions by ``by`` only, which is fine only for small groups. With
    ``bucket_out`` the bucket stays as that column: the result is then
    hash-partitioned by (``by``, bucket), which a later group-by on a
    superset of those keys reuses without a shuffle."""
    by, order = list(by), list(order)
    agg = _AGG[how]
    v = F.col(value) if isinstance(value, str) else value
    df = df.withColumn("__v", v)
    hi = 0 if inclusive else -1
    if bucket is None:
        if not by:
            raise ValueError("a global running aggregate needs a bucket expression")
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, hi)
        return df.withColumn(out, agg("__v").over(w)).drop("__v")
    b = df.withColumn(_B, bucket)
    w = Window.partitionBy(*by, _B).orderBy(*order).rowsBetween(Window.unboundedPreceding, hi)
    local = b.withColumn("__local", agg("__v").over(w))
    totals = materialize(df.sparkSession, b.groupBy(*by, _B).agg(agg("__v").alias("__tot")), "bucket-totals")
    # written too: from its known size Spark plans a broadcast up front, and
    # the rows keep the partitioning of their window
    bases = materialize(df.sparkSession, _bases(totals, by, how), "bucket-bases")
    if bases.count() > BROADCAST_ROWS:  # from the file footers
        bases = bases.hint("merge")
    res = _null_safe(local, bases, [*by, _B])
    comb = _combine(how, F.col("__base"), F.col("__local"))
    res = res.withColumn(out, comb).drop("__local", "__base", "__v")
    return res.withColumnRenamed(_B, bucket_out) if bucket_out else res.drop(_B)


def running_sum(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = (),
                bucket: Column | None = None, out: str = "offset",
                inclusive: bool = False, bucket_out: str | None = None) -> DataFrame:
    """Add ``out`` = running sum of ``value`` (as bigint) in ``order``
    within ``by``; exclusive (0 for the first row) unless ``inclusive``."""
    r = running(df, F.col(value).cast("bigint"), "sum", order, by, bucket, out, inclusive=True,
                bucket_out=bucket_out)
    if not inclusive:
        r = r.withColumn(out, F.col(out) - F.col(value).cast("bigint"))
    return r


def ordinal(df: DataFrame, order: Sequence[str], by: Sequence[str] = (),
            bucket: Column | None = None, out: str = "ordinal") -> DataFrame:
    """0-based row number in ``order`` within ``by``, two-level as above.
    ``order`` must be unique within ``by``."""
    return running_sum(df.withColumn("__one", F.lit(1)), "__one", order, by, bucket, out).drop("__one")


def count_by(df: DataFrame, by: Sequence[str], out: str = "n") -> DataFrame:
    """``df`` with the row count of its ``by`` group joined on (the count
    table has one row per group), or of the whole table as a scalar subquery."""
    if by:
        # written, as the bases above: a few counts are broadcast and the rows stay where they are
        counts = materialize(df.sparkSession, df.groupBy(*by).agg(F.count("*").alias(out)), "counts")
        return _null_safe(df, counts if counts.count() <= BROADCAST_ROWS else counts.hint("merge"), by)
    return df.withColumn(out, df.agg(F.count("*")).scalar())
