"""The tokenize job: new raw files -> token-shard files, restartable.

One run lists the corpus files of a format, leaves out those in the
manifest, tokenizes the rest, packs them per writer part into files
numbered after those already there, writes them, and records the inputs
(files without rows too) and the outputs last. A run that fails before that
leaves no record: the next one takes the same inputs, gives the same numbers
and replaces what was half written.

A shard file takes four bytes a token, several times its text. What a run
needs on disk besides the files stays small: ids are shuffled in 16 bits
where they fit, shuffle files go after each step, and the table of token ids
goes at the end of the run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, shuffles_removed, written_meanwhile
from . import packing

ORDER_ROWS = 1 << 40  # rows a raw file may hold


def _rows(spark: SparkSession, files: DataFrame, root, fmt: str, schema: str | None) -> DataFrame:
    """Rows of the listed files with ``file_path`` and ``id_in_file``."""
    from ..sources import readers
    pattern = readers.glob_filter(fmt)
    if fmt == "jsonl":
        rows = readers.read_jsonl_positions(spark, root, schema, pattern=readers.PLAIN_JSONL)
    elif fmt == "json":
        rows = readers.read_json_positions(spark, root, schema, pattern=pattern)
    elif fmt == "parquet":
        rows = readers.read_parquet_positions(spark, root, pattern=pattern)
    else:
        rows = readers.read_whole_text(spark, root, pattern=pattern).withColumn("id_in_file", F.lit(0).cast("bigint"))
    return rows.join(files.select(F.col("path").alias("file_path"), "file_rank"), "file_path")


def pretokenize(spark: SparkSession, root: str, fmt: str, out_dir: str, prefix: str | Column, spec: packing.PackSpec,
                schema: str | None = None, text: str | Column = "text", fn: Callable[[DataFrame], DataFrame] | None = None,
                tokenizer=None, dtype: str = "i4", accept: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """Run the job on the files of ``root`` that are not done yet; returns
    ``(file_name, num_tokens, num_special_tokens)`` of the files written.

    ``prefix`` names the corpus (a literal or a column of the rows), ``text``
    picks the field, ``fn`` is the row hook. Writer part of a document:
    hash of its file mod ``spec.shards``; documents keep their file's order.
    ``accept`` is given the written files before the run is recorded; what it
    raises fails the run, whose files stay where they are.
    """
    with shuffles_removed(spark):
        return _run(spark, root, fmt, out_dir, prefix, spec, schema, text, fn, tokenizer, dtype, accept)


def _run(spark, root, fmt, out_dir, prefix, spec, schema, text, fn, tokenizer, dtype, accept) -> DataFrame:
    from ..sources import readers, sinks
    manifest = f"{out_dir}/_manifest"
    pattern = readers.PLAIN_JSONL if fmt == "jsonl" else readers.glob_filter(fmt)  # archives are unpacked beforehand
    files = readers.list_files(spark, root, pattern).select("path")
    new = sinks.new_files(files, sinks.read_manifest(spark, f"{manifest}/inputs")).select("path", "sig")
    # the listing is one short row per file; its rank gives documents an order
    new = materialize(spark, _ranked(new), "new-files")
    if new.isEmpty():
        return spark.createDataFrame([], "file_name string, num_tokens long, num_special_tokens long")
    rows = _rows(spark, new, root, fmt, schema)
    rows = rows.transform(fn) if fn is not None else rows
    pre = F.lit(prefix) if isinstance(prefix, str) else prefix
    body = F.col(text) if isinstance(text, str) else text
    docs = rows.select(pre.alias("prefix"), F.pmod(F.xxhash64("file_path"), F.lit(spec.shards)).alias("shard"),
                       (F.col("file_rank") * ORDER_ROWS + F.col("id_in_file")).alias("doc_order"), body.alias("text"))
    tok = packing.tokenize(docs, "text", tokenizer=tokenizer, add_bos=spec.add_bos, add_eos=spec.add_eos).drop("text")
    done = _done(spark, manifest)
    first = sinks.next_file_no(done)
    batch = str(_runs(spark, manifest).count())  # the number of a run that failed is used again; a run without rows has one too
    with written_meanwhile(spark, tok, "pretokenized") as tok:
        pieces = packing.pack_shards(tok, spec, ["prefix", "shard"], "doc_order", narrow=True)
        pieces = pieces.join(first, ["prefix", "shard"], "left") \
            .withColumn("file_no", F.col("file_no") + F.coalesce("next_no", F.lit(0))).drop("next_no")
        written = materialize(spark, sinks.export_shards(pieces, out_dir, prefix="prefix", dtype=dtype, narrow=True), "written-files")
    if accept is not None:
        accept(written)
    written.write.mode("overwrite").parquet(f"{manifest}/outputs/batch={batch}")
    sinks.append_manifest(new.select("path"), f"{manifest}/inputs", batch=batch)
    return written


def _ranked(files: DataFrame) -> DataFrame:
    """0-based rank of the file's signature, by buckets of its first digits."""
    from .ordering import bucket_hex, ordinal
    return ordinal(files, ["sig", "path"], bucket=bucket_hex("sig", 4), out="file_rank")


def _runs(spark: SparkSession, manifest: str) -> DataFrame:
    """``(batch)`` of the finished runs: their inputs are recorded last."""
    from ..sources.readers import path_exists
    if not path_exists(spark, f"{manifest}/inputs"):
        return spark.createDataFrame([], "batch string")
    return spark.read.schema("path string, batch string").parquet(f"{manifest}/inputs").select("batch").distinct()


def _done(spark: SparkSession, manifest: str) -> DataFrame:
    """Outputs of finished runs. The files of a run that failed before its
    inputs were recorded are numbered and written again."""
    from ..sources.readers import path_exists
    schema = "file_name string, num_tokens long, num_special_tokens long"
    if not path_exists(spark, f"{manifest}/outputs"):
        return spark.createDataFrame([], schema)
    out = spark.read.schema(f"{schema}, batch string").parquet(f"{manifest}/outputs")
    return out.join(_runs(spark, manifest), "batch", "left_semi").drop("batch")
