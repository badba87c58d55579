"""Token shards through their Spark data source, and buffered shuffles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import buffered, packing
from ..session import scratch_path
from ..sources import shard_source
from . import packing_plans as pp
from . import source_plans  # noqa: F401  (registers shard_import, whose SQL is used here too)
from .registry import ORACLE, query
from .tables import table

BUFFER = 16
SEED = 1234


@query("shard_source", sql=ORACLE["shard_import"])
def q_shard_source(spark, sf_dir):
    """S16 + K1: shard files written and read back in C-token chunks by
    ``token_shards``, the data source."""
    shard_source.register(spark)
    out = scratch_path(spark, "shards")
    pieces = packing.pack_shards(pp.tokenized(spark, sf_dir), pp.SPEC, pp.BY, "doc_id")
    shard_source.lay_out(pieces).write.format(shard_source.FORMAT).mode("append").save(out)
    ch = spark.read.format(shard_source.FORMAT).option("chunk_tokens", pp.SPEC.context).load(out)
    return ch.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("file_name"), "chunk_no", F.md5(F.array_join("ids", ",")).alias("ids_md5"))


@query("shuffle_buffered", sql=f"""
WITH d AS (
  SELECT doc_id, source || '-' || (doc_id % 10) AS file,
         row_number() OVER (PARTITION BY source, doc_id % 10 ORDER BY doc_id) - 1 AS k FROM documents),
s AS (
  SELECT *, CASE WHEN k < {BUFFER} THEN k ELSE ('0x' || substr(md5('{SEED}:' || file || ':' || k), 1, 13))::BIGINT % {BUFFER} END AS seat FROM d),
n AS (SELECT *, lead(k) OVER (PARTITION BY file, seat ORDER BY k) AS leaves, count(*) OVER (PARTITION BY file) AS size FROM s)
SELECT doc_id, file, coalesce(leaves - {BUFFER}, greatest(size - {BUFFER}, 0) + row_number() OVER (
         PARTITION BY file, leaves IS NULL ORDER BY md5('{SEED}:' || file || ':end:' || seat)) - 1)::BIGINT AS position
FROM n""")
def q_shuffle_buffered(spark, sf_dir):
    """Each file of the corpus is a reader with a swap buffer. A
    row leaves when the next row draws its seat; the SQL says the same of
    the whole table at once."""
    file = F.concat("source", F.lit("-"), (F.col("doc_id") % 10).cast("string"))
    docs = table(spark, sf_dir, "documents").select("doc_id", file.alias("file"))
    return buffered.buffered_shuffle(docs, BUFFER, SEED, reader="file", order=("doc_id",))
