"""SFT and untokenized-text queries: row split per file, shuffle, packing
and truncation over rendered chats; concatenate-and-chunk over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chat, mixing, packing, splits
from ..operators.ordering import bucket_hex, count_by, ordinal
from ..functions.hashing import order_key
from .chat_plans import raw_from_value
from .registry import query
from .tables import table

SEED = 42
RATE = 0.005
C = 2048
STREAM = packing.PackSpec(context=C, file_tokens=1 << 40, shards=1, add_bos=False, add_eos=True)


def chats(spark, sf_dir):
    """Rendered chats, spread over five chat files by ``conv_id mod 5``."""
    c = chat.from_value(raw_from_value(spark, sf_dir))
    return c.withColumn("file", F.concat(F.lit("chat_"), (F.col("id") % 5).cast("string"), F.lit(".parquet"))) \
        .withColumn("id", F.col("id").cast("string"))


def sft_split(spark, sf_dir):
    return splits.split_rows(chats(spark, sf_dir), RATE, SEED, "id", by=["file"])


_SPLIT_SQL = f"""
sp AS (
  SELECT conv_id::VARCHAR AS id, 'chat_' || (conv_id % 5)::VARCHAR || '.parquet' AS file, conv_id,
         row_number() OVER (PARTITION BY conv_id % 5 ORDER BY md5('{SEED}:' || conv_id::VARCHAR), conv_id::VARCHAR) - 1 AS pos,
         count(*) OVER (PARTITION BY conv_id % 5) AS n
  FROM (SELECT DISTINCT conv_id FROM conversations)),
sl AS (SELECT id, file, conv_id, CASE WHEN pos < ceil(n * {RATE}::DOUBLE) THEN 'validation' ELSE 'train' END AS split FROM sp),
sh AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY md5('{SEED}:' || id), id) - 1 AS position FROM sl)"""


@query("sft_split", sql=f"""
WITH {_SPLIT_SQL}
SELECT id, file, split FROM sl""")
def q_sft_split(spark, sf_dir):
    return sft_split(spark, sf_dir).select("id", "file", "split")


def sft_shuffled(spark, sf_dir):
    """U1 + R9: the split tables concatenated, each shuffled with seed 42."""
    s = sft_split(spark, sf_dir).withColumn("__key", order_key(SEED, F.col("id")))
    return ordinal(s, ["__key", "id"], by=["split"], bucket=bucket_hex("__key", 4), out="position").drop("__key")


@query("sft_shuffle", sql=f"""
WITH {_SPLIT_SQL}
SELECT id, split, position FROM sh""")
def q_sft_shuffle(spark, sf_dir):
    return sft_shuffled(spark, sf_dir).select("id", "split", "position")


@query("sft_cached", sql=f"""
WITH {_SPLIT_SQL}
SELECT id, split, position FROM sh""")
def q_sft_cached(spark, sf_dir):
    """Build the split tables once into the shared folder, then serve
    them from there (the second call reads the written tables)."""
    from ..session import scratch_path
    from ..sources import readers
    base = scratch_path(spark, "sft")
    readers.cached_splits(spark, base, lambda: sft_shuffled(spark, sf_dir))
    return readers.cached_splits(spark, base, lambda: sft_shuffled(spark, sf_dir)) \
        .select("id", "split", "position")


# DuckDB: token count of a rendered chat (each special string is one token)
_CHAT_TOKENS = f"""
ct AS (SELECT conv_id::VARCHAR AS id, (sum(strlen(role) + strlen(text) + 6) + 1)::BIGINT AS n
       FROM conversations GROUP BY conv_id),
st AS (SELECT sh.*, ct.n FROM sh JOIN ct USING (id)),
so AS (SELECT *, (sum(n) OVER (PARTITION BY split ORDER BY position
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n)::BIGINT AS start FROM st)"""


@query("sft_pack", sql=f"""
WITH {_SPLIT_SQL}, {_CHAT_TOKENS},
w AS (SELECT split, position, start, n, unnest(generate_series(start // {C}, (start + n - 1) // {C})) AS win FROM so),
p AS (SELECT split, win, position, least(start + n, (win + 1) * {C}) - greatest(start, win * {C}) AS len FROM w)
SELECT split, win, count(*) AS n_pieces, min(position) AS first_position, max(position) AS last_position
FROM p GROUP BY split, win HAVING sum(len) = {C}""")
def q_sft_pack(spark, sf_dir):
    """W4 packing on: rendered chats + EOS in shuffled order, cut into C-token windows."""
    s = sft_shuffled(spark, sf_dir)
    t = packing.tokenize(s.select("split", "position", "text"), "text", add_eos=True).drop("text")
    w = packing.pack_windows(t, STREAM, ["split"], "position")
    return w.select("split", "win", "n_pieces", "first_position", "last_position")


@query("sft_truncate", sql=f"""
WITH {_SPLIT_SQL}, {_CHAT_TOKENS}
SELECT id, split, least(n - 1, {C}) AS n_tokens, n - 1 > {C} AS truncated FROM st""")
def q_sft_truncate(spark, sf_dir):
    """W4 packing off: one sample per chat, cut to C tokens (no EOS)."""
    t = packing.tokenize(sft_shuffled(spark, sf_dir), "text", add_eos=False)
    return t.select("id", "split", F.size(F.slice("ids", 1, C)).cast("bigint").alias("n_tokens"),
                    (F.col("n_tokens") > C).alias("truncated"))


def _text_windows_sql(epochs: int) -> str:
    return f"""
WITH b AS (
  SELECT doc_id, source, strlen(text) + 1 AS n,
         list_concat(list_transform(regexp_extract_all(hex(encode(text)), '..'),
                                    lambda x: ('0x' || x)::INTEGER + 17), [0]) AS toks,
         row_number() OVER (PARTITION BY source ORDER BY md5('1234:' || doc_id::VARCHAR), doc_id::VARCHAR) - 1 AS rk,
         count(*) OVER (PARTITION BY source) AS n_docs
  FROM documents),
d AS (SELECT doc_id, source, n, toks, e * n_docs + rk AS position FROM b, (SELECT unnest(range({epochs})) AS e)),
o AS (SELECT *, (sum(n) OVER (PARTITION BY source ORDER BY position
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n)::BIGINT AS start FROM d),
w AS (SELECT *, unnest(generate_series(start // {C}, (start + n - 1) // {C})) AS win FROM o),
p AS (SELECT source, win, doc_id, greatest(start, win * {C}) AS lo, least(start + n, (win + 1) * {C}) AS hi, start, toks
      FROM w),
pc AS (SELECT source, win, doc_id, lo, hi - lo AS len,
              array_to_string(list_slice(toks, lo - start + 1, hi - start), ',') AS s FROM p)
SELECT source, win, count(*) AS n_pieces, arg_min(doc_id, lo) AS first_doc_id,
       md5(string_agg(s, ',' ORDER BY lo)) AS ids_md5
FROM pc GROUP BY source, win HAVING sum(len) = {C}"""


def _text_windows(spark, sf_dir, epochs: int):
    """Documents per source in shuffled order, ``epochs`` times over, EOS
    after each, cut into C-token windows: the tail of one epoch is the head
    of the next, the last tail is dropped."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    d = d.withColumn("doc_key", F.col("doc_id").cast("string"))
    x = d.withColumn("__key", order_key(1234, F.col("doc_key")))
    x = ordinal(x, ["__key", "doc_key"], by=["source"], bucket=bucket_hex("__key", 4), out="position")
    if epochs > 1:
        x = mixing.repeat_epochs(count_by(x, ["source"], "n_docs"), epochs) \
            .withColumn("position", F.col("epoch") * F.col("n_docs") + F.col("position"))
    t = packing.tokenize(x.select("doc_id", "source", "position", "text"), "text", add_eos=True).drop("ids")
    wp = packing.window_pieces(t, STREAM, ["source"], "position", keep=["doc_id"], text="text")
    g = wp.groupBy("source", "win").agg(
        F.array_sort(F.collect_list(F.struct("win_offset", packing.narrow_ids().alias("ids")))).alias("parts"),
        F.sum("len").alias("n"), F.count("*").alias("n_pieces"),
        F.min_by("doc_id", "win_offset").alias("first_doc_id")).filter(F.col("n") == C)
    return g.select(
        "source", "win", "n_pieces", "first_doc_id",
        F.md5(F.array_join(F.flatten(F.transform("parts", lambda s: packing.full_ids(s["ids"]))), ",")).alias("ids_md5"))


@query("pack_text", sql=_text_windows_sql(1))
def q_pack_text(spark, sf_dir):
    """Untokenized corpus (per source) as windows."""
    return _text_windows(spark, sf_dir, 1)


@query("pack_text_epochs", sql=_text_windows_sql(2))
def q_pack_text_epochs(spark, sf_dir):
    """W3 + R10: the tail is carried into the next epoch."""
    return _text_windows(spark, sf_dir, 2)
