"""Document adapter, text corpora and row hooks over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chat, documents, packing, registry
from ..operators.ordering import bucket_numeric, ordinal
from .chat_plans import turns
from .registry import query
from .tables import table


@query("doc_adapt", sql="""
SELECT doc_id::VARCHAR AS id, md5(text) AS text_md5, 'documents' AS dataset_name,
       'lang=' || lang || ';n_chars=' || n_chars || ';source=' || source AS metadata, 0 AS n_media
FROM documents""")
def q_doc_adapt(spark, sf_dir):
    d = documents.adapt(table(spark, sf_dir, "documents"), "documents", id_key="doc_id")
    return d.select("id", F.md5("text").alias("text_md5"), "dataset_name",
                    documents.metadata_string("metadata").alias("metadata"), F.size("media").alias("n_media"))


@query("doc_metadata_wrap", sql="""
SELECT event_id,
       CASE WHEN event_id % 2 = 0 THEN 'k=' || (props::JSON->>'k') ELSE 'metadata=' || event_type END AS metadata
FROM events""")
def q_doc_metadata_wrap(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    raw = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.col("event_type"))
    return ev.select("event_id", documents.metadata_string(documents.wrap_metadata(raw)).alias("metadata"))


@query("doc_metadata_merge", sql="""
SELECT event_id,
       'event_type=' || event_type || ';k=' ||
       CASE WHEN event_id % 3 = 0 THEN user_id::VARCHAR ELSE props::JSON->>'k' END || ';src=meta' AS metadata
FROM events""")
def q_doc_metadata_merge(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    meta = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("src"), F.lit("meta")))
    data = F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("k"),
                        F.when(F.col("event_id") % 3 == 0, F.col("user_id").cast("string")))
    return ev.select("event_id", documents.metadata_string(documents.merge_metadata(meta, data)).alias("metadata"))


@query("doc_default_id", sql="""
SELECT doc_id,
       CASE WHEN doc_id % 3 <> 0 THEN doc_id::VARCHAR
            ELSE 'docs/' || source || '.jsonl/' || (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::VARCHAR
       END AS id
FROM documents""")
def q_doc_default_id(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    d = d.withColumn("id", F.when(F.col("doc_id") % 3 != 0, F.col("doc_id").cast("string")).otherwise(F.lit("")))
    d = d.withColumn("path", F.concat(F.lit("docs/"), F.col("source"), F.lit(".jsonl")))
    d = ordinal(d, ["doc_id"], by=["path"], bucket=bucket_numeric("doc_id", 1 << 16), out="pos")
    default = F.concat_ws("/", F.col("path"), F.col("pos").cast("string"))
    a = documents.adapt(d.select("doc_id", "id", "text", "path", "pos"), "docs", default_id=default)
    return a.select(F.element_at("metadata", F.lit("doc_id")).cast("bigint").alias("doc_id"), "id")


@query("text_title_content", sql="""
SELECT page_id, md5(coalesce(url, 'None') || ' ' || coalesce(html, 'None')) AS text_md5,
       strlen(coalesce(url, 'None') || ' ' || coalesce(html, 'None')) AS n_bytes
FROM pages""")
def q_text_title_content(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("title"), F.col("html").alias("content"))
    t = registry.title_content(p)
    return t.select("page_id", F.md5("text").alias("text_md5"), F.octet_length("text").cast("bigint").alias("n_bytes"))


def _wanjuan(spark, sf_dir):
    """``pages`` in the titled-web-text shape (13 columns)."""
    p = table(spark, sf_dir, "pages")
    return p.select(F.col("page_id").cast("string").alias("id"), F.col("html").alias("content"),
                    F.col("url").alias("title"), F.lit("en").alias("language"), F.lit("2024-01-01").alias("date"),
                    F.octet_length("html").alias("token_num"), F.octet_length("html").alias("cbytes_num"),
                    F.lit(1).alias("line_num"), F.length("html").alias("char_num"),
                    F.lit(0.0).alias("toxic_score"), F.lit(1.0).alias("fluency_score"),
                    F.lit(1.0).alias("not_ad_score"), F.lit(0.0).alias("porn_score"))


@query("text_drop_cols", sql="""
SELECT md5(coalesce(url, 'None') || ' ' || coalesce(html, 'None')) AS text_md5, 1 AS n_columns FROM pages""")
def q_text_drop_cols(spark, sf_dir):
    t = registry.corpus_text("wanjuan-cc", _wanjuan(spark, sf_dir))
    return t.select(F.md5("text").alias("text_md5"), F.lit(len(t.columns)).alias("n_columns"))


@query("text_from_content", sql="""
SELECT page_id::VARCHAR AS url, md5(html) AS text_md5 FROM pages""")
def q_text_from_content(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("string").alias("url"), F.col("html").alias("content"),
        F.lit(None).cast("timestamp").alias("timestamp"), F.lit("d").alias("dump"),
        F.lit("s").alias("segment"), F.array().cast("array<string>").alias("image_urls"))
    t = registry.corpus_text("RefinedWeb", p.withColumn("url_copy", F.col("url")))
    return t.select(F.col("url_copy").alias("url"), F.md5("text").alias("text_md5"))


@query("corpus_registry", sql=f"""
SELECT 'wanjuan-cc' AS corpus, count(*) AS n_rows, sum(strlen(coalesce(url, 'None') || ' ' || coalesce(html, 'None')))::BIGINT AS n_bytes FROM pages
UNION ALL SELECT 'SkyPile', count(*), sum(strlen(text))::BIGINT FROM documents
UNION ALL SELECT 'StarCoderData', count(*), sum(strlen(text))::BIGINT FROM documents
UNION ALL SELECT 'RefinedWeb', count(*), sum(strlen(html))::BIGINT FROM pages
UNION ALL SELECT 'FakeText', {len(registry.FAKE_TEXTS)}, {sum(len(t.encode()) for t in registry.FAKE_TEXTS)}""")
def q_corpus_registry(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    pages = table(spark, sf_dir, "pages")
    parts = {
        "wanjuan-cc": registry.corpus_text("wanjuan-cc", _wanjuan(spark, sf_dir)),
        "SkyPile": registry.corpus_text("SkyPile", docs.select("text")),
        "StarCoderData": registry.corpus_text("StarCoderData", docs.select(F.col("text").alias("content"))),
        "RefinedWeb": registry.corpus_text("RefinedWeb", pages.select(F.col("url"), F.col("html").alias("content"))),
        "FakeText": registry.fake_texts(spark),
    }
    out = None
    for name, df in parts.items():
        s = df.agg(F.count("*").alias("n_rows"), F.sum(F.octet_length("text")).cast("bigint").alias("n_bytes")) \
            .select(F.lit(name).alias("corpus"), "n_rows", "n_bytes")
        out = s if out is None else out.unionByName(s)
    return out


@query("filter_hook", sql="""
SELECT source, count(*) AS n_docs, sum(strlen(text) + 1)::BIGINT AS n_tokens
FROM documents WHERE lang = 'en' AND n_chars >= 200 GROUP BY source""")
def q_filter_hook(spark, sf_dir):
    """A row hook that drops rows (``None``) is a ``where``."""
    d = table(spark, sf_dir, "documents").where((F.col("lang") == "en") & (F.col("n_chars") >= 200))
    t = packing.tokenize(d.select("source", "text"), "text")
    return t.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").cast("bigint").alias("n_tokens"))


@query("chat_drop_empty", sql="""
SELECT conv_id::VARCHAR || '/' || turn::VARCHAR AS id,
       md5(CASE WHEN role = 'assistant' THEN '' ELSE text END) AS text_md5
FROM conversations WHERE role <> 'assistant' AND length(text) > 0""")
def q_chat_drop_empty(spark, sf_dir):
    """P12 over every turn; assistant turns stand for empty documents."""
    c = table(spark, sf_dir, "conversations")
    d = c.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
                 F.when(F.col("role") == "assistant", F.lit("")).otherwise(F.col("text")).alias("text"))
    return chat.drop_empty(d).select("id", F.md5("text").alias("text_md5"))
