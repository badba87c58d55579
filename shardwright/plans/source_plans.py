"""Scan and sink queries. Each writes a driver table in the format under
test into a fresh folder of the shared checkpoint folder, reads it back
with the library's reader and reports what came back."""

from __future__ import annotations

import io
import json
import os
import tarfile
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import names
from ..functions.hashing import hash52
from ..operators import documents, splits
from ..session import scratch_path, shuffles_removed
from ..sources import position_index, quarantine, readers, sinks
from . import packing_plans as pp
from .chat_plans import raw_from_value
from .registry import query
from .tables import table

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
GROUP_ROWS = 100   # rows per written JSON-array file / archive
FOLDER_GROUPS = 10  # groups of text files per folder


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _write_jsonl_by_source(spark, sf_dir, compression="gzip"):
    """One JSON Lines file per source (rows in doc_id order), gzip."""
    out = scratch_path(spark, "jsonl")
    (_docs(spark, sf_dir).repartition("source").sortWithinPartitions("source", "doc_id")
     .write.option("compression", compression).partitionBy("source").json(out))
    return out


_DOC_ROWS = "SELECT doc_id, md5(text) AS text_md5, lang, source FROM documents"


def _doc_rows(df):
    return df.select("doc_id", F.md5("text").alias("text_md5"), "lang", "source")


@query("scan_parquet", sql=_DOC_ROWS)
def q_scan_parquet(spark, sf_dir):
    out = scratch_path(spark, "parquet")
    _docs(spark, sf_dir).write.parquet(out)
    return _doc_rows(readers.read_parquet(spark, out))


@query("scan_content", sql="SELECT md5(text) AS text_md5 FROM documents")
def q_scan_content(spark, sf_dir):
    out = scratch_path(spark, "content")
    _docs(spark, sf_dir).withColumnRenamed("text", "content").write.parquet(out)
    from ..operators import registry
    return registry.content_only(readers.read_parquet(spark, out)).select(F.md5("text").alias("text_md5"))


@query("scan_jsonl", sql=_DOC_ROWS)
def q_scan_jsonl(spark, sf_dir):
    out = _write_jsonl_by_source(spark, sf_dir)
    df = readers.read_jsonl(spark, out, "doc_id long, text string, lang string, n_chars long",
                            pattern=readers.glob_filter("jsonl"))
    df = df.withColumn("source", F.regexp_extract(F.col("_metadata.file_path"), "source=([^/]+)", 1))
    return _doc_rows(df)


@query("scan_jsonl_pos", sql="""
SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS id_in_file FROM documents""")
def q_scan_jsonl_pos(spark, sf_dir):
    out = _write_jsonl_by_source(spark, sf_dir)
    df = readers.read_jsonl_positions(spark, out, "doc_id long, text string", pattern="*.json.gz")
    return df.select("doc_id", "id_in_file")


@query("scan_limit_skip", sql="""
SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS k FROM documents)
WHERE k >= 5 AND k < 5 + 100""")
def q_scan_limit_skip(spark, sf_dir):
    out = _write_jsonl_by_source(spark, sf_dir)
    df = readers.read_jsonl_positions(spark, out, "doc_id long", pattern="*.json.gz")
    df = df.withColumn("source", F.regexp_extract("file_path", "source=([^/]+)", 1))
    return readers.skip_limit_by_file(df, "source", skip=5, limit=100).select("doc_id")


@query("scan_position_index", sql="""
WITH d AS (SELECT *, row_number() OVER (ORDER BY source, doc_id) - 1 AS position,
                  row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents),
-- files are read in the order of md5('7:<source>')
f AS (SELECT source, count(*) AS n, md5('7:' || source) AS k FROM documents GROUP BY source),
b AS (SELECT source, sum(n) OVER (ORDER BY k, source) - n AS base FROM f)
SELECT 'skip' AS part, position, doc_id::VARCHAR AS id, md5(text) AS text_md5, 'lang=' || lang || ';n_chars=' || n_chars || ';split=all' AS metadata
FROM d WHERE position >= n // 3 AND position < n // 3 + n // 2
UNION ALL
SELECT 'shuffled', (base + pos)::BIGINT, source, md5(lang), 'doc_id=' || doc_id || ';n_chars=' || n_chars || ';text=' || md5(text)
FROM d JOIN b USING (source)""")
def q_scan_position_index(spark, sf_dir):
    """Plain files with skip and limit, and compressed files
    in a seeded order with other text and id keys, all by a stored index."""
    d = _docs(spark, sf_dir)
    n = d.count()

    def lines(docs, codec):  # in ranges of (source, doc_id): a large source has many files, in name order
        out = scratch_path(spark, "jsonl-ranges")
        docs.repartitionByRange("source", "doc_id").sortWithinPartitions("source", "doc_id") \
            .write.option("compression", codec).partitionBy("source").json(out)
        return out

    index = position_index.build_index(spark, lines(d, "none"), scratch_path(spark, "index"), pattern="*.json")
    some = position_index.read_documents(index, "doc_id long, text string, lang string, n_chars long", id_key="doc_id",
                                         default_metadata={"split": "all", "lang": "?"}, skip=n // 3, limit=n // 2)
    some = some.select(F.lit("skip").alias("part"), "position", "id", F.md5("text").alias("text_md5"),
                       documents.metadata_string("metadata").alias("metadata"))
    packed = lines(d.select("source", "doc_id", F.md5("text").alias("text"), "lang", "n_chars"), "gzip")
    by_source = F.md5(F.concat(F.lit("7:"), F.regexp_extract("file_path", "source=([^/]+)", 1)))
    index = position_index.build_index(spark, packed, scratch_path(spark, "index"), pattern="*.json.gz", order=by_source)
    rest = position_index.read_documents(index, "doc_id long, text string, lang string, n_chars long", text_key="lang")
    rest = rest.select(F.lit("shuffled").alias("part"), "position", F.regexp_extract("id", "source=([^/]+)/[^/]+/\\d+$", 1).alias("id"),
                       F.md5("text").alias("text_md5"), documents.metadata_string("metadata").alias("metadata"))
    return some.unionByName(rest)


# Records broken on purpose: a cut line, and a number that is a word.
_CUT, _WORD = 3, 7


@query("scan_quarantine", sql=f"""
WITH d AS (SELECT *, CASE n_chars % 50 WHEN {_CUT} THEN 'not JSON' WHEN {_WORD} THEN 'does not fit the schema' END AS reason FROM documents)
SELECT source, coalesce(reason, 'good') AS side, count(*) AS n_rows,
       sum(CASE WHEN reason IS NULL THEN ('0x' || substr(md5(text), 1, 13))::BIGINT::HUGEINT END)::VARCHAR AS text_hash,
       (SELECT count(*) FROM d WHERE reason IS NULL) AS n_good, (SELECT count(*) FROM d WHERE reason IS NOT NULL) AS n_bad
FROM d GROUP BY source, reason""")
def q_scan_quarantine(spark, sf_dir):
    """JSON Lines with broken records; good rows, bad rows by
    reason, and the counts taken while both sides were written."""
    out = scratch_path(spark, "broken-jsonl")
    kind = F.col("n_chars") % 50
    d = _docs(spark, sf_dir).withColumn("line", F.to_json(F.struct("doc_id", "text", "lang", "n_chars")))
    broken = F.when(kind == _CUT, F.expr("left(line, length(line) - 1)")) \
        .when(kind == _WORD, F.regexp_replace("line", r'"n_chars":\d+', '"n_chars":"many"')).otherwise(F.col("line"))
    d.select("source", broken.alias("value")).write.partitionBy("source").text(out)
    got = quarantine.quarantine(quarantine.read_checked(spark, out, "doc_id long, text string, lang string, n_chars long", pattern="*.txt"))
    rows = got.good.select("file_path", F.lit("good").alias("side"), hash52(F.md5("text")).cast("decimal(38,0)").alias("h")) \
        .unionByName(got.bad.select("file_path", F.col("reason").alias("side"), F.lit(None).cast("decimal(38,0)").alias("h")))
    return rows.groupBy(F.regexp_extract("file_path", "source=([^/]+)", 1).alias("source"), "side").agg(
        F.count("*").alias("n_rows"), F.sum("h").cast("string").alias("text_hash")) \
        .withColumn("n_good", F.lit(got.n_good).cast("bigint")).withColumn("n_bad", F.lit(got.n_bad).cast("bigint"))


def _write_json_arrays(spark, sf_dir):
    """JSON array files of GROUP_ROWS documents each (doc_id order)."""
    out = scratch_path(spark, "jsonarray")
    d = _docs(spark, sf_dir).withColumn("grp", F.floor(F.col("doc_id") / GROUP_ROWS))
    arr = d.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct(
        "doc_id", F.to_json(F.struct("doc_id", "text", "lang", "source", "n_chars")).alias("j")))).alias("rows"))
    txt = arr.select("grp", F.concat(F.lit("["), F.array_join(F.transform("rows", lambda r: r["j"]), ","),
                                     F.lit("]")).alias("value"))
    txt.repartition("grp").write.partitionBy("grp").option("lineSep", "\n").text(out)
    return out


@query("scan_json_array", sql=_DOC_ROWS)
def q_scan_json_array(spark, sf_dir):
    out = _write_json_arrays(spark, sf_dir)
    return _doc_rows(readers.read_json_array(spark, out, DOC_SCHEMA, pattern="*.txt"))


@query("scan_json_pos", sql=f"SELECT doc_id, doc_id % {GROUP_ROWS} AS id_in_file FROM documents")
def q_scan_json_pos(spark, sf_dir):
    out = _write_json_arrays(spark, sf_dir)
    return readers.read_json_positions(spark, out, DOC_SCHEMA, pattern="*.txt").select("doc_id", "id_in_file")


def _write_tars(out_dir):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grp = int(pdf["grp"].iloc[0])
        pdf = pdf.sort_values("doc_id")
        lines = "\n".join(json.dumps({"doc_id": int(r.doc_id), "text": r.text, "lang": r.lang,
                                      "source": r.source, "n_chars": int(r.n_chars)}, ensure_ascii=False)
                          for r in pdf.itertuples()).encode("utf-8") + b"\n"
        path = os.path.join(out_dir, f"part-{grp:05d}.jsonl.tar.gz")
        tmp = f"{path}.{os.getpid()}-{id(pdf)}.tmp"
        with tarfile.open(tmp, "w:gz") as tar:
            for name, data in ((f"part-{grp:05d}.jsonl", lines), ("README.txt", b"not data\n")):
                info = tarfile.TarInfo(name)
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
        os.replace(tmp, path)
        return pd.DataFrame({"grp": [grp], "n": [len(pdf)]})
    return run


@query("scan_tar", sql=_DOC_ROWS)
def q_scan_tar(spark, sf_dir):
    out = scratch_path(spark, "tar")
    os.makedirs(out, exist_ok=True)
    d = _docs(spark, sf_dir).withColumn("grp", F.floor(F.col("doc_id") / GROUP_ROWS))
    d.groupBy("grp").applyInPandas(_write_tars(out), "grp long, n long").write.format("noop").mode("overwrite").save()
    return _doc_rows(readers.read_tar(spark, out, DOC_SCHEMA))


@query("scan_whole_text", sql="SELECT doc_id, md5(text) AS text_md5 FROM documents")
def q_scan_whole_text(spark, sf_dir):
    out = scratch_path(spark, "text")

    def write(batches):
        made = set()
        for batch in batches:
            for k in range(0, batch.num_rows, GROUP_ROWS):   # texts of a few rows at a time
                for r in batch.slice(k, GROUP_ROWS).to_pylist():
                    folder = os.path.join(out, str(r["doc_id"] // (GROUP_ROWS * FOLDER_GROUPS)))   # many folders are listed by tasks
                    if folder not in made:
                        os.makedirs(folder, exist_ok=True)
                        made.add(folder)
                    with open(os.path.join(folder, f"doc-{r['doc_id']}.txt"), "w", encoding="utf-8") as f:
                        f.write(r["text"])
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})
    os.makedirs(out, exist_ok=True)
    _docs(spark, sf_dir).select("doc_id", "text").mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()
    t = readers.read_whole_text(spark, out, pattern=readers.glob_filter("text"))
    return t.select(F.regexp_extract("file_path", r"doc-(\d+)\.txt$", 1).cast("bigint").alias("doc_id"),
                    F.md5("text").alias("text_md5"))


@query("scan_glob", sql="""
SELECT 'jsonl' AS handler, count(DISTINCT source) AS n_files FROM documents
UNION ALL SELECT 'parquet', count(DISTINCT lang) FROM documents
UNION ALL SELECT 'text', 0""")
def q_scan_glob(spark, sf_dir):
    root = scratch_path(spark, "glob")
    d = _docs(spark, sf_dir)
    # AQE's rebalance deals a large source or language to many tasks: it is a
    # folder of part files, and counts as one file as any written table does
    d.hint("rebalance", "source").write.option("compression", "gzip").partitionBy("source").json(f"{root}/jsonl")
    d.hint("rebalance", "lang").write.partitionBy("lang").parquet(f"{root}/parquet")
    out = None
    for fmt in ("jsonl", "parquet", "text"):
        n = readers.list_files(spark, root, readers.glob_filter(fmt)).agg(
            F.count_distinct(F.regexp_extract("path", "^(.*)/", 1)).alias("n_files"))
        s = n.select(F.lit(fmt).alias("handler"), "n_files")
        out = s if out is None else out.unionByName(s)
    return out


@query("load_split", sql="""
WITH f AS (SELECT source, row_number() OVER (ORDER BY md5('42:' || source), source) AS rank,
                  count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents))
SELECT d.doc_id, CASE WHEN rank <= least(n - 1, floor(n * (1 - 0.1::DOUBLE))) THEN 'train' ELSE 'validation' END AS split
FROM documents d JOIN f USING (source)""")
def q_load_split(spark, sf_dir):
    """List the corpus files, split them by rate (T1), read both sides."""
    out = _write_jsonl_by_source(spark, sf_dir)
    files = readers.list_files(spark, out, readers.glob_filter("jsonl")) \
        .withColumn("source", F.regexp_extract("path", "source=([^/]+)", 1))
    sp = splits.split_rate(files, 0.1, 42, name="source")
    rows = readers.read_jsonl(spark, out, "doc_id long").withColumn("path", F.col("_metadata.file_path"))
    return rows.join(sp.select("path", "split"), "path").select("doc_id", "split")


@query("chat_write", sql="""
SELECT conv_id::VARCHAR AS id, CASE WHEN conv_id % 2 = 0 THEN 'SlimOrca' ELSE 'ultra_chat' END AS dataset_name,
       md5(string_agg('<|im_start|>' || role || ':' || chr(10) || ' ' || text || '<|im_end|>' || chr(10), '' ORDER BY turn)) AS text_md5,
       md5(string_agg(role || '=' || text, '|' ORDER BY turn)) AS chat_md5, count(*) AS n_turns
FROM conversations GROUP BY conv_id""")
def q_chat_write(spark, sf_dir):
    """K2: two datasets written by one sink and read back: texts, chats and
    the dataset names of the files."""
    from ..operators import chat
    name = F.when(F.col("id").cast("bigint") % 2 == 0, F.lit("SlimOrca")).otherwise(F.lit("ultra_chat"))
    c = chat.from_value(raw_from_value(spark, sf_dir)).withColumn("dataset_name", name)
    back = sinks.write_chat(c, scratch_path(spark, "chat"), max_file_bytes=64 * 1024)
    turns_text = F.array_join(F.transform("chat", lambda x: F.concat(x["role"], F.lit("="), x["content"])), "|")
    return back.select(F.col("id").cast("string").alias("id"), "dataset_name", F.md5("text").alias("text_md5"),
                       F.md5(turns_text).alias("chat_md5"), F.size("chat").cast("bigint").alias("n_turns"))


@query("shard_export", sql=f"""
WITH s AS ({pp._STATS_SQL})
SELECT printf('%s-%03d-%05d.data', source, shard, file_no) AS file_name, num_tokens, num_special_tokens,
       'i4' AS dtype
FROM s""")
def q_shard_export(spark, sf_dir):
    from ..operators import packing
    out = scratch_path(spark, "shards")
    pieces = packing.pack_shards(pp.tokenized(spark, sf_dir), pp.SPEC, pp.BY, "doc_id")
    sinks.export_shards(pieces, out).write.format("noop").mode("overwrite").save()
    h = sinks.shard_headers(spark, out)
    return h.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("file_name"), "num_tokens",
                    "num_special_tokens", "dtype")


@query("shard_import", sql=f"""
WITH {pp._DOC_TOKENS},
wp AS (
  SELECT source, shard, file_no, toks, piece_from, file_offset,
         greatest(file_offset, c * {pp.SPEC.context}) AS wlo,
         least(file_offset + piece_len, (c + 1) * {pp.SPEC.context}) AS whi, c
  FROM (SELECT *, unnest(generate_series(file_offset // {pp.SPEC.context},
                                         (file_offset + piece_len - 1) // {pp.SPEC.context})) AS c FROM p)),
pc AS (
  SELECT source, shard, file_no, c, wlo,
         array_to_string(list_slice(toks, piece_from + wlo - file_offset + 1,
                                    piece_from + wlo - file_offset + whi - wlo), ',') AS s
  FROM wp)
SELECT printf('%s-%03d-%05d.data', source, shard, file_no) AS file_name, c AS chunk_no,
       md5(string_agg(s, ',' ORDER BY wlo)) AS ids_md5
FROM pc GROUP BY source, shard, file_no, c""")
def q_shard_import(spark, sf_dir):
    """S16 + K1 round trip: export the shard files, read them back in
    C-token chunks."""
    from ..operators import packing
    out = scratch_path(spark, "shards")
    pieces = packing.pack_shards(pp.tokenized(spark, sf_dir), pp.SPEC, pp.BY, "doc_id")
    sinks.export_shards(pieces, out).write.format("noop").mode("overwrite").save()
    ch = sinks.import_shards(spark, out, pp.SPEC.context)
    return ch.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("file_name"), "chunk_no",
                     F.md5(F.array_join("ids", ",")).alias("ids_md5"))


@query("resume_new_files", sql="""
WITH f AS (SELECT DISTINCT 'raw/' || source || '/part-' || (doc_id % 10)::VARCHAR || '.jsonl' AS path, doc_id % 10 AS k
           FROM documents)
SELECT path, sha256(path) AS sig FROM f WHERE k >= 5""")
def q_resume_new_files(spark, sf_dir):
    """K4 + J1: inputs whose path signature is not in the manifest; the
    manifest holds the first five parts of every source."""
    d = _docs(spark, sf_dir).select(
        F.concat(F.lit("raw/"), F.col("source"), F.lit("/part-"), (F.col("doc_id") % 10).cast("string"),
                 F.lit(".jsonl")).alias("path"), (F.col("doc_id") % 10).alias("k")).distinct()
    manifest_path = scratch_path(spark, "manifest")
    sinks.append_manifest(d.filter(F.col("k") < 5), manifest_path)
    return sinks.new_files(d, sinks.read_manifest(spark, manifest_path)).select("path", "sig")


class _Stopped(Exception):
    """Ends a tokenize run that has written its files."""


def _stop(written):
    raise _Stopped


@query("pretokenize_resume", sql="""
SELECT source AS prefix, sum(strlen(text) + 1)::BIGINT AS num_tokens, count(*) AS num_special_tokens
FROM documents GROUP BY source""")
def q_pretokenize_resume(spark, sf_dir):
    """The tokenize job in two waves: half of the files, a failed run whose
    files are left behind, then all; every document is there once."""
    from ..operators import packing
    from ..operators.pretokenize import pretokenize
    root, out = scratch_path(spark, "raw"), scratch_path(spark, "tokens")
    d = _docs(spark, sf_dir).select("source", "doc_id", "text")
    spec = packing.PackSpec(context=2048, file_tokens=50_000, shards=4)
    prefix = F.regexp_extract("file_path", "source=([^/]+)", 1)
    for wave in (0, 1):
        # a large source has many files, as a gzip file is read by one task
        with shuffles_removed(spark):
            d.filter(F.pmod("doc_id", F.lit(2)) == wave).withColumn("s", F.col("source")).hint("rebalance", "source") \
                .write.option("compression", "gzip").partitionBy("source").json(f"{root}/wave{wave}")
        run = partial(pretokenize, spark, root, "jsonl", out, prefix, spec, schema="doc_id long, text string")
        if wave:
            try:
                run(accept=_stop)
            except _Stopped:
                pass
        run()
    heads = sinks.shard_headers(spark, out)
    return heads.groupBy(names.shard_prefix("path").alias("prefix")).agg(
        F.sum("num_tokens").cast("bigint").alias("num_tokens"), F.sum("num_special_tokens").cast("bigint").alias("num_special_tokens"))


@query("read_hooks", sql="""
SELECT doc_id, upper(lang) AS lang, md5(text) AS text_md5 FROM documents WHERE n_chars >= 100""")
def q_read_hooks(spark, sf_dir):
    """Format dispatch with a row map and a row filter."""
    root = scratch_path(spark, "hooks")
    _docs(spark, sf_dir).write.json(root)
    df = readers.read_format(spark, root, "jsonl", schema="doc_id long, lang string, text string, n_chars long",
                             fn=lambda x: x.withColumn("lang", F.upper("lang")), where="n_chars >= 100")
    return df.select("doc_id", "lang", F.md5("text").alias("text_md5"))


@query("json_print", sql="""
SELECT doc_id, '{' || chr(10) || '    "doc_id": ' || doc_id::VARCHAR || ',' || chr(10) || '    "lang": "' || lang || '",' || chr(10)
       || '    "sizes": [' || chr(10) || '        ' || n_chars::VARCHAR || ',' || chr(10) || '        1' || chr(10) || '    ]' || chr(10) || '}' AS text
FROM documents""")
def q_json_print(spark, sf_dir):
    """JSON text printed again with an indent of four."""
    d = _docs(spark, sf_dir)
    raw = F.to_json(F.struct("doc_id", "lang", F.array("n_chars", F.lit(1)).alias("sizes")))
    return d.select("doc_id", readers.pretty_text(raw).alias("text"))


@query("choose_split", sql="""
WITH f AS (SELECT DISTINCT 'data/' || CASE WHEN doc_id % 3 = 0 THEN 'train' ELSE 'validation' END || '/' || source || '-' || printf('%03d', doc_id % 7)
                  || '-00000.data' AS file_name, source, doc_id % 3 = 0 AS is_train, doc_id % 7 AS part FROM documents),
     g AS (SELECT DISTINCT '000_' || source || '_' || printf('%05d', doc_id % 5) || '.parquet' AS file_name, source, doc_id % 5 AS part FROM documents),
     r AS (SELECT file_name, row_number() OVER (ORDER BY md5('42:' || file_name), file_name) AS rank, count(*) OVER () AS n FROM g)
SELECT 'folder' AS route, file_name, CASE WHEN is_train THEN 'train' ELSE 'validation' END AS split FROM f
UNION ALL
SELECT 'rate', file_name, CASE WHEN rank <= least(n - 1, floor(n * (1 - 0.1::DOUBLE))) THEN 'train' ELSE 'validation' END FROM r""")
def q_choose_split(spark, sf_dir):
    """T5: two of the split routes over file names of the corpus."""
    d = _docs(spark, sf_dir)
    part = lambda k: (F.col("doc_id") % k).cast("int")
    side = F.when(F.col("doc_id") % 3 == 0, F.lit("train")).otherwise(F.lit("validation"))
    f = d.select(F.concat_ws("/", F.lit("data"), side, F.format_string("%s-%03d-00000.data", "source", part(7))).alias("file_name")).distinct()
    g = d.select(F.format_string("000_%s_%05d.parquet", "source", part(5)).alias("file_name")).distinct()
    a = splits.choose_split(f, 42, folder_split=True).select(F.lit("folder").alias("route"), "file_name", "split")
    b = splits.choose_split(g, 42, validation_rate=0.1).select(F.lit("rate").alias("route"), "file_name", "split")
    return a.unionByName(b)
