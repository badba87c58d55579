"""Streaming queries: driver tables written as a sequence of files, then
consumed by file-source streams with ``availableNow`` triggers."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import tokens
from ..operators import packing
from ..session import scratch_path
from ..streaming import incremental
from . import report_plans
from .registry import query
from .tables import table

ARRIVALS = 6   # triggers the events arrive in
FILE_EVENTS = 1 << 17   # events per file
GROUP_EVENTS, LEAST_GROUPS = 1 << 13, 64   # events of an arrival per group of runs
C = 2048
# Documents: sqrt(n / 320) arrivals dealt to sqrt(n / 16) shards, so a shard
# gets about 70 documents an arrival however large the table is.
ARRIVAL_ROWS, SHARD_ROWS = 320, 16


def _write_ordered_files(df, key: str, files: int, out_dir: str) -> int:
    """Write ``df`` as about ``files`` JSON Lines files, each a range of
    ``key`` (nulls last, equal keys together), and stamp increasing
    modification times: a file source reads them in the order of ``key``,
    however many it takes per trigger. Returns the number of files."""
    by = F.col(key).asc_nulls_last()
    df.repartitionByRange(files, by).sortWithinPartitions(by).write.json(out_dir)
    jvm = df.sparkSession.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(out_dir)
    store = root.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())
    found = sorted((f.getPath() for f in store.listStatus(root) if f.getPath().getName().startswith("part-")),
                   key=lambda p: p.getName())
    for k, path in enumerate(found):
        store.setTimes(path, (1_600_000_000 + k) * 1000, -1)
    return len(found)


@query("stream_new_files", sql="""
SELECT source, count(*) AS n_docs, sum(strlen(text) + 1)::BIGINT AS n_tokens FROM documents GROUP BY source""")
def q_stream_new_files(spark, sf_dir):
    """Two arrivals of files (even, then odd sources); the second run
    resumes from the checkpoint and only reads the new files."""
    base = scratch_path(spark, "ingest")
    inp, out, ckpt = f"{base}/in", f"{base}/out", f"{base}/ckpt"
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    even = F.regexp_extract("source", r"(\d+)$", 1).cast("int") % 2 == 0
    docs.filter(even).write.json(f"{inp}/wave=0")
    schema = "doc_id long, source string, text string"
    incremental.ingest_new_files(spark, inp, out, ckpt, schema, keep=("doc_id", "source"))
    docs.filter(~even).write.json(f"{inp}/wave=1")
    incremental.ingest_new_files(spark, inp, out, ckpt, schema, keep=("doc_id", "source"))
    tok = spark.read.parquet(f"{out}/tokens")
    return tok.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").cast("bigint").alias("n_tokens"))


@query("stream_pack", sql=f"""
WITH s AS (SELECT greatest(1, ceil(sqrt(count(*) / {SHARD_ROWS}.0)))::BIGINT AS n_shards FROM documents),
d AS (
  SELECT doc_id, doc_id % (SELECT n_shards FROM s) AS shard, strlen(text) + 1 AS n,
         list_concat(list_transform(regexp_extract_all(hex(encode(text)), '..'),
                                    lambda x: ('0x' || x)::INTEGER + 17), [0]) AS toks
  FROM documents),
o AS (SELECT *, (sum(n) OVER (PARTITION BY shard ORDER BY doc_id
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n)::BIGINT AS start FROM d),
w AS (SELECT *, unnest(generate_series(start // {C}, (start + n - 1) // {C})) AS win FROM o),
p AS (SELECT shard, win, doc_id, greatest(start, win * {C}) AS lo, least(start + n, (win + 1) * {C}) AS hi, start, toks
      FROM w),
pc AS (SELECT shard, win, doc_id, lo, hi - lo AS len,
              array_to_string(list_slice(toks, lo - start + 1, hi - start), ',') AS s FROM p)
SELECT shard::INTEGER AS shard, win, arg_min(doc_id, lo) AS first_doc_id, md5(string_agg(s, ',' ORDER BY lo)) AS ids_md5
FROM pc GROUP BY shard, win HAVING sum(len) = {C}""")
def q_stream_pack(spark, sf_dir):
    """Documents arrive in doc_id order in files, one per trigger;
    windows per shard carry their partial tail across triggers. Files and
    shards both grow with the square root of the table."""
    base = scratch_path(spark, "streampack")
    inp, out, ckpt = f"{base}/in", f"{base}/out", f"{base}/ckpt"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = docs.count()
    arrivals, shards = (max(1, math.ceil(math.sqrt(n / per))) for per in (ARRIVAL_ROWS, SHARD_ROWS))
    files = _write_ordered_files(docs, "doc_id", arrivals, inp)
    stream = spark.readStream.schema("doc_id long, text string") \
        .option("maxFilesPerTrigger", math.ceil(files / arrivals)).json(inp)
    tok = packing.assign_shard(packing.tokenize(stream, "text"), "doc_id", shards)
    incremental.run_to_parquet(incremental.pack_stream(tok, C, as_bytes=True), out, ckpt, rocksdb=True)
    w = spark.read.parquet(out)
    return w.select("shard", "win", "first_doc_id", F.md5(tokens.joined(tokens.from_bytes("input_ids"))).alias("ids_md5"))


@query("stream_plateau", sql=report_plans.ORACLE_PLATEAU)
def q_stream_plateau(spark, sf_dir):
    """Z3: evaluation events arrive in the order of their time, in ARRIVALS
    triggers; the plateau counters of each run live in state. Files and
    groups of runs grow with the table."""
    base = scratch_path(spark, "streamplateau")
    inp, out, ckpt = f"{base}/in", f"{base}/out", f"{base}/ckpt"
    ev = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), "event_id", "ts", "value")
    n = ev.count()
    files = _write_ordered_files(ev, "ts", ARRIVALS * math.ceil(max(n, 1) / (ARRIVALS * FILE_EVENTS)), inp)
    stream = spark.readStream.schema("run long, event_id long, ts timestamp_ntz, value double") \
        .option("maxFilesPerTrigger", math.ceil(files / ARRIVALS)).json(inp)
    groups = max(LEAST_GROUPS, math.ceil(n / (ARRIVALS * GROUP_EVENTS)))
    incremental.run_to_parquet(incremental.plateau_stream(stream, report_plans.PLATEAU_LIMIT, groups=groups), out, ckpt)
    return spark.read.parquet(out).select("run", "event_id", "step", "best", "improved", "bad", "alert")
