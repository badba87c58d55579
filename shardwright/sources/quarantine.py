"""Readers that set bad records aside instead of failing: good rows, a side
table of bad ones with file, place and reason, and the counts of both.

``read_checked`` judges every record where it is read; ``quarantine`` writes
both sides in that one pass over the input and counts them on the way with
``observe``, so nothing is read twice and no count needs a job of its own.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

NOT_JSON = "not JSON"
NOT_AN_ARRAY = "not a JSON array"
MISFIT = "does not fit the schema"

_CORRUPT = "_corrupt_record"


def _judged(record: Column, is_item: Column, schema: str | T.StructType) -> Column:
    """``{r, reason}``: the parsed record, or the reason against it. A value
    that is not an object, or a field of another type, is a misfit; a missing
    field is null and an unknown one ignored."""
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    parsed = F.from_json(record, T.StructType([*fields, T.StructField(_CORRUPT, T.StringType())]))

    # the parse is bound to a variable: asked for one field alone, Spark would
    # parse that field alone and see no misfit in the others
    def judge(p):
        reason = F.when(~is_item, NOT_AN_ARRAY).when(record.isNull(), MISFIT).when(F.try_parse_json(record).isNull(), NOT_JSON) \
            .when(~F.ltrim(record).startswith("{") | p.isNull() | p[_CORRUPT].isNotNull(), MISFIT)
        return F.struct(F.when(reason.isNull(), F.struct(*[p[f.name].alias(f.name) for f in fields])).alias("r"), reason.alias("reason"))

    return F.get(F.transform(F.array(parsed), judge), 0)


def read_checked(spark: SparkSession, root, schema: str | T.StructType, fmt: str = "jsonl",
                 pattern: str | None = None) -> DataFrame:
    """``(file_path, place, record, r, reason)`` of every record: ``jsonl``
    has one a line (blank lines are none; ``place`` is null, lines have no
    number where large files are read in splits), ``json`` one an item of the
    file's array (``place``: its position). A ``json`` file that is no array
    is one bad record, its whole text; an empty array has no record."""
    if fmt not in ("jsonl", "json"):
        raise ValueError(f"no checked reader for {fmt!r}")
    r = spark.read.option("recursiveFileLookup", True)
    r = r.option("pathGlobFilter", pattern) if pattern else r
    raw = r.text(root, wholetext=fmt == "json").select(F.col("_metadata.file_path").alias("file_path"), F.col("value"))
    if fmt == "jsonl":
        items = raw.filter(F.trim("value") != "").select("file_path", F.lit(None).cast("bigint").alias("place"),
                                                         F.col("value").alias("record"), F.lit(True).alias("__item"))
    else:
        # a broken file stands as one item without a place
        parsed = F.when(F.ltrim("value").startswith("["), F.from_json("value", "array<string>"))
        whole = F.array(F.struct(F.lit(None).cast("bigint").alias("place"), F.col("value").alias("record"), F.lit(False).alias("__item")))
        each = F.transform(parsed, lambda x, i: F.struct(i.cast("bigint").alias("place"), x.alias("record"), F.lit(True).alias("__item")))
        items = raw.select("file_path", F.inline(F.when(parsed.isNull(), whole).otherwise(each)))
    return items.withColumn("__j", _judged(F.col("record"), F.col("__item"), schema)) \
        .select("file_path", "place", "record", F.col("__j.r").alias("r"), F.col("__j.reason").alias("reason"))


class Checked(NamedTuple):
    good: DataFrame   # file_path, place and the schema's columns
    bad: DataFrame    # file_path, place, reason, record
    n_good: int
    n_bad: int


def quarantine(checked: DataFrame, base: str | None = None) -> Checked:
    """Write the two sides of ``read_checked`` under ``base`` (default: the
    session's scratch folder) and return them with their counts."""
    spark = checked.sparkSession
    base = base or scratch_path(spark, "quarantine")
    seen = Observation()
    bad = F.col("reason").isNotNull()
    (checked.withColumn("record", F.when(bad, F.col("record"))).withColumn("side", F.when(bad, "bad").otherwise("good"))
     .observe(seen, F.count_if(~bad).alias("good"), F.count_if(bad).alias("bad"))
     .write.mode("overwrite").partitionBy("side").parquet(base))
    # the schema is given: the written folder lacks a side without rows
    back = spark.read.schema(T.StructType([*checked.schema.fields, T.StructField("side", T.StringType())])).parquet(base)
    return Checked(back.filter("side = 'good'").select("file_path", "place", "r.*"),
                   back.filter("side = 'bad'").select("file_path", "place", "reason", "record"),
                   seen.get["good"], seen.get["bad"])
