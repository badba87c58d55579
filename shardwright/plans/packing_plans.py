"""Queries of the token pipeline over ``documents``: tokenize, shard files,
windows, counts. Each document table is a corpus whose prefix is ``source``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, tokens
from ..operators import packing
from ..session import materialize
from .registry import query
from .tables import table

# Parameters of the corpus packing queries (kept small so that the test
# scale factors cross many files and windows).
SPEC = packing.PackSpec(context=2048, file_tokens=10_000, shards=4, add_bos=False, add_eos=True)
BY = ["source", "shard"]

# DuckDB: documents with their byte-token lists (bytes + 17, then EOS 0) and
# the stream start of each document inside (source, doc_id % K).
_DOC_TOKENS = f"""
d AS (
  SELECT doc_id, source, doc_id % {SPEC.shards} AS shard, strlen(text) + 1 AS n,
         list_concat(list_transform(regexp_extract_all(hex(encode(text)), '..'),
                                    lambda x: ('0x' || x)::INTEGER + 17), [0]) AS toks
  FROM documents),
o AS (
  SELECT *, (sum(n) OVER (PARTITION BY source, shard ORDER BY doc_id
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n)::BIGINT AS start
  FROM d),
fp AS (
  SELECT *, greatest(start, file_no * {SPEC.file_tokens}) AS lo,
         least(start + n, (file_no + 1) * {SPEC.file_tokens}) AS hi
  FROM (SELECT *, unnest(generate_series(start // {SPEC.file_tokens},
                                         (start + n - 1) // {SPEC.file_tokens})) AS file_no FROM o)),
p AS (
  SELECT source, shard, file_no, doc_id, n, toks, lo - start AS piece_from, hi - lo AS piece_len,
         lo - file_no * {SPEC.file_tokens} AS file_offset
  FROM fp)
"""


def tokenized(spark, sf_dir, cols=("doc_id", "source", "text"), tokenizer=None):
    """Tokenized documents with their writer part. The packing steps read
    the token table twice (lengths for the offsets, then the ids), so an
    expensive tokenizer's output is written once to the shared folder; the
    byte tokenizer is cheaper to re-run than to write (measured)."""
    tok_impl = tokenizer or tokens.DEFAULT_TOKENIZER
    docs = table(spark, sf_dir, "documents").select(*cols)
    tok = packing.tokenize(docs, "text", tokenizer=tok_impl, add_bos=SPEC.add_bos,
                           add_eos=SPEC.add_eos).drop("text")
    tok = packing.assign_shard(tok, "doc_id", SPEC.shards).withColumn("shard", F.col("shard").cast("bigint"))
    return tok if getattr(tok_impl, "cheap", False) else materialize(spark, tok, "tokens")


@query("tokenize_counts", sql="""
SELECT doc_id, strlen(text) + 1 AS n_tokens,
       md5(array_to_string(list_concat(list_transform(regexp_extract_all(hex(encode(text)), '..'),
                                       lambda x: ('0x' || x)::INTEGER + 17), [0]), ',')) AS ids_md5
FROM documents""")
def q_tokenize_counts(spark, sf_dir):
    t = tokenized(spark, sf_dir, ("doc_id", "text"))
    return t.select("doc_id", "n_tokens", F.md5(F.array_join("ids", ",")).alias("ids_md5"))


@query("detokenize", sql="""
SELECT doc_id, md5(text) AS text_md5, true AS round_trip FROM documents""")
def q_detokenize(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = docs.withColumn("back", tokens.decode(tokens.encode("text")))
    return back.select("doc_id", F.md5("back").alias("text_md5"),
                       (F.col("back") == F.col("text")).alias("round_trip"))


@query("pack_shards", sql=f"""
WITH {_DOC_TOKENS}
SELECT source, shard, file_no, file_offset, doc_id, piece_from, piece_len,
       md5(array_to_string(list_slice(toks, piece_from + 1, piece_from + piece_len), ',')) AS ids_md5,
       (list_slice(toks, piece_from + 1, piece_from + piece_len)[1] = 0)::INTEGER
       + (list_slice(toks, piece_from + 1, piece_from + piece_len)[piece_len] = 0)::INTEGER AS num_special_tokens
FROM p""")
def q_pack_shards(spark, sf_dir):
    pieces = packing.pack_shards(tokenized(spark, sf_dir), SPEC, BY, "doc_id")
    return pieces.select(*BY, "file_no", "file_offset", "doc_id", "piece_from", "piece_len",
                         F.md5(F.array_join("ids", ",")).alias("ids_md5"), "num_special_tokens")


_STATS_SQL = f"""
WITH {_DOC_TOKENS}
SELECT source, shard, file_no, sum(piece_len)::BIGINT AS num_tokens,
       sum((list_slice(toks, piece_from + 1, piece_from + piece_len)[1] = 0)::INTEGER
           + (list_slice(toks, piece_from + 1, piece_from + piece_len)[piece_len] = 0)::INTEGER)::BIGINT
         AS num_special_tokens
FROM p GROUP BY ALL"""


def stats(spark, sf_dir):
    return packing.shard_stats(packing.pack_shards(tokenized(spark, sf_dir), SPEC, BY, "doc_id"), BY)


@query("shard_stats", sql=_STATS_SQL)
def q_shard_stats(spark, sf_dir):
    return stats(spark, sf_dir)


@query("shard_names", sql=f"""
WITH s AS ({_STATS_SQL})
SELECT printf('%s-%03d-%05d.data', source, shard, file_no) AS file_name,
       regexp_extract(printf('%s-%03d-%05d.data', source, shard, file_no), '^(.+)-\\d{{3}}-\\d{{5}}\\.data$', 1) AS prefix,
       num_tokens
FROM s""")
def q_shard_names(spark, sf_dir):
    f = packing.file_table(stats(spark, sf_dir), "source")
    return f.select("file_name", names.shard_prefix("file_name").alias("prefix"), "num_tokens")


@query("pack_special_counts", sql=f"""
WITH s AS ({_STATS_SQL})
SELECT source, sum(num_tokens)::BIGINT AS num_tokens, sum(num_special_tokens)::BIGINT AS num_special_tokens,
       count(*) AS n_files
FROM s GROUP BY source""")
def q_pack_special_counts(spark, sf_dir):
    return stats(spark, sf_dir).groupBy("source").agg(
        F.sum("num_tokens").cast("bigint").alias("num_tokens"),
        F.sum("num_special_tokens").cast("bigint").alias("num_special_tokens"),
        F.count("*").alias("n_files"))


@query("sample_counts", sql=f"""
WITH s AS ({_STATS_SQL})
SELECT source, sum(num_tokens // {SPEC.context})::BIGINT AS samples,
       sum(num_tokens // {SPEC.context} * {SPEC.context})::BIGINT AS sample_tokens
FROM s GROUP BY source""")
def q_sample_counts(spark, sf_dir):
    return packing.sample_counts(stats(spark, sf_dir), SPEC.context, ["source"])


_WINDOWS_SQL = f"""
WITH {_DOC_TOKENS},
wp AS (
  SELECT source, shard, file_no, doc_id, toks, piece_from, file_offset,
         greatest(file_offset, win * {SPEC.context}) AS wlo,
         least(file_offset + piece_len, (win + 1) * {SPEC.context}) AS whi, win
  FROM (SELECT *, unnest(generate_series(file_offset // {SPEC.context},
                                         (file_offset + piece_len - 1) // {SPEC.context})) AS win FROM p)
  WHERE win < {SPEC.file_tokens // SPEC.context}),
pc AS (
  SELECT source, shard, file_no, win, doc_id, wlo, whi - wlo AS len,
         array_to_string(list_slice(toks, piece_from + wlo - file_offset + 1,
                                    piece_from + wlo - file_offset + whi - wlo), ',') AS s
  FROM wp)
SELECT source, shard, file_no, win, count(*) AS n_pieces,
       arg_min(doc_id, wlo) AS first_doc_id, arg_max(doc_id, wlo) AS last_doc_id,
       md5(string_agg(s, ',' ORDER BY wlo)) AS ids_md5
FROM pc GROUP BY source, shard, file_no, win
HAVING sum(len) = {SPEC.context}"""


@query("pack_windows", sql=_WINDOWS_SQL)
def q_pack_windows(spark, sf_dir):
    w = packing.pack_windows(tokenized(spark, sf_dir), SPEC, BY, "doc_id")
    return w.select(*BY, "file_no", "win", "n_pieces", "first_doc_id", "last_doc_id",
                    F.md5(F.array_join("input_ids", ",")).alias("ids_md5"))


@query("write_windows", sql=_WINDOWS_SQL)
def q_write_windows(spark, sf_dir):
    """W2 as a written table: the ids go through one shuffle."""
    from ..session import scratch_path
    w = packing.write_windows(tokenized(spark, sf_dir), SPEC, BY, "doc_id", scratch_path(spark, "windows"))
    return w.select(*BY, "file_no", "win", "n_pieces", "first_doc_id", "last_doc_id",
                    F.md5(F.array_join("input_ids", ",")).alias("ids_md5"))


@query("training_samples", sql=f"""
SELECT source, shard, file_no, win, ids_md5, ids_md5 AS labels_md5, {SPEC.context} AS n_labels FROM ({_WINDOWS_SQL})""")
def q_training_samples(spark, sf_dir):
    """F11 + F12: windows as bigint samples with their labels."""
    w = packing.training_samples(packing.pack_windows(tokenized(spark, sf_dir), SPEC, BY, "doc_id"))
    return w.select(*BY, "file_no", "win", F.md5(F.array_join("input_ids", ",")).alias("ids_md5"),
                    F.md5(F.array_join("labels", ",")).alias("labels_md5"), F.size("labels").alias("n_labels"))
