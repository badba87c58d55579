"""Token streams: shard files and fixed-length training windows.

A writer part ("shard") concatenates its documents in order into one token
stream, cut into files of exactly ``file_tokens`` tokens (a document may
cross files, the last file is shorter). Training windows are consecutive
runs of ``context`` tokens inside one file; the tail of each file shorter
than ``context`` is dropped.

Plan: tokens per document come from an Arrow UDF; the document's start in
its shard stream is a two-level running sum (see ``ordering``); a document
is exploded into the (file, window) pieces it overlaps with ``sequence`` +
``slice``; pieces are grouped by window, so a group never holds more than
``context`` ids, and ordered by their offset. No step holds a whole shard.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, tokens
from .ordering import bucket_numeric, running_sum, with_adaptive_bucket, with_range_bucket


@dataclass(frozen=True)
class PackSpec:
    context: int = 2048                 # C, tokens per training window
    file_tokens: int = 200 * 1024 * 1024  # M, tokens per shard file
    shards: int = 32                    # K, writer parts per corpus
    bucket_rows: int = 1 << 15          # rows per running-sum bucket and shard
    # order keys are dense integers (ordinals, ids): fixed-width buckets;
    # set False for sparse keys (e.g. hashed ids) to size buckets per stream
    dense_order: bool = True
    add_bos: bool = False
    add_eos: bool = True


def tokenize(df: DataFrame, text: str = "text", tokenizer=None, add_bos: bool = False,
             add_eos: bool = True, out: str = "ids") -> DataFrame:
    """Add ``out`` (array<int>) and ``n_tokens``; F3 + F4."""
    ids = tokens.add_specials(tokens.encode(text, tokenizer), add_bos, add_eos)
    return df.withColumn(out, ids).withColumn("n_tokens", F.size(out).cast("bigint"))


def assign_shard(df: DataFrame, key: str, shards: int, out: str = "shard") -> DataFrame:
    """Writer part of a row: ``key mod shards`` for integer keys, a hash of
    the key otherwise. Rows of a part keep ``key`` order."""
    k = F.col(key)
    dt = dict(df.dtypes)[key]
    if dt in ("int", "bigint", "smallint", "tinyint"):
        part = F.pmod(k, F.lit(shards))
    else:
        part = F.pmod(F.xxhash64(k), F.lit(shards))
    return df.withColumn(out, part.cast("int"))


SB = "stream_bucket"


def stream_offsets(df: DataFrame, spec: PackSpec, by: list[str], order: str,
                   numeric_order: bool = True, keep_bucket: bool = False) -> DataFrame:
    """Add ``start``: the row's first token position in its (``by``) stream
    (and, with ``keep_bucket``, the running-sum bucket as ``stream_bucket``)."""
    whole = dict(df.dtypes)[order] in ("tinyint", "smallint", "int", "bigint")
    adaptive = numeric_order and whole and not spec.dense_order
    if numeric_order and not whole:  # e.g. string keys: buckets from their ranges
        df = with_range_bucket(df, [*by, order], out="__ab")
        bucket, adaptive = F.col("__ab"), True
    elif adaptive:
        # about ``bucket_rows`` rows per bucket in every stream, whatever the key spacing
        df = with_adaptive_bucket(df, order, by, spec.bucket_rows, out="__ab")
        bucket = F.col("__ab")
    elif numeric_order:
        bucket = bucket_numeric(order, spec.shards * spec.bucket_rows)
    else:
        bucket = F.conv(F.substring(F.col(order).cast("string"), 1, 4), 16, 10).cast("bigint")
    r = running_sum(df, "n_tokens", [order], by=by, bucket=bucket, out="start",
                    bucket_out=SB if keep_bucket else None)
    return r.drop("__ab") if adaptive else r


def _file_pieces(df: DataFrame, M: int) -> DataFrame:
    """Explode each row into the shard-file pieces it covers."""
    f = F.explode(F.expr(f"sequence(start div {M}, (start + n_tokens - 1) div {M})"))
    x = df.filter(F.col("n_tokens") > 0).withColumn("file_no", f)
    lo = F.greatest(F.col("start"), F.col("file_no") * M)
    hi = F.least(F.col("start") + F.col("n_tokens"), (F.col("file_no") + 1) * M)
    return (x.withColumn("piece_from", lo - F.col("start"))       # offset inside the document
             .withColumn("piece_len", hi - lo)
             .withColumn("file_offset", lo - F.col("file_no") * M))


def pack_shards(tok: DataFrame, spec: PackSpec, by: list[str], order: str,
                keep: list[str] = (), narrow: bool = False) -> DataFrame:
    """W1 + X3: pieces ``(*by, file_no, file_offset, <order>, piece_from,
    piece_len, ids, num_special_tokens)``; ``tok`` holds ``ids`` and
    ``n_tokens``. The pieces of one file in ``file_offset`` order are the
    file's token array. With ``narrow`` the offset step shuffles ids in 16
    bits where they fit (``narrow_ids``): less disk for more CPU time."""
    if narrow:
        tok = tok.withColumn("ids", narrow_ids("ids"))
    p = _file_pieces(stream_offsets(tok, spec, by, order), spec.file_tokens)
    part = lambda c: F.slice(c, F.col("piece_from").cast("int") + 1, F.col("piece_len").cast("int"))
    ids = full_ids({k: part(F.col("ids")[k]) for k in ("small", "wide")}) if narrow else part("ids")
    return p.select(*by, "file_no", "file_offset", order, *keep, "piece_from", "piece_len",
                    ids.alias("ids")).withColumn("num_special_tokens", tokens.piece_special_count(F.col("ids")))


def shard_stats(pieces: DataFrame, by: list[str]) -> DataFrame:
    """A2: per file, ``num_tokens`` and ``num_special_tokens`` (the file header)."""
    return pieces.groupBy(*by, "file_no").agg(
        F.sum("piece_len").cast("bigint").alias("num_tokens"),
        F.sum("num_special_tokens").cast("bigint").alias("num_special_tokens"))


def window_pieces(tok: DataFrame, spec: PackSpec, by: list[str], order: str,
                  keep_bucket: bool = False, keep: list[str] = (), text: str | None = None) -> DataFrame:
    """Pieces of each document inside each training window it overlaps;
    ``keep`` names further columns to carry. With ``text``, ``tok`` holds
    that column instead of ``ids``: the offset step shuffles the text, which
    takes a quarter of the bytes, and tokenizes it once it is in its place."""
    C, M = spec.context, spec.file_tokens
    placed = stream_offsets(tok, spec, by, order, keep_bucket=keep_bucket)
    if text is not None:
        placed = placed.withColumn("ids", tokens.add_specials(tokens.encode(text), spec.add_bos, spec.add_eos)).drop(text)
    p = _file_pieces(placed, M)
    wseq = F.expr(f"sequence(file_offset div {C}, (file_offset + piece_len - 1) div {C})")
    x = p.withColumn("win", F.explode(wseq)).filter(F.col("win") < F.lit(M // C))
    lo = F.greatest(F.col("file_offset"), F.col("win") * C)
    hi = F.least(F.col("file_offset") + F.col("piece_len"), (F.col("win") + 1) * C)
    from_doc = F.col("piece_from") + (lo - F.col("file_offset"))
    return x.select(*by, *([SB] if keep_bucket else []), "file_no", "win", order, *keep,
                    (lo - F.col("win") * C).cast("int").alias("win_offset"),
                    from_doc.alias("doc_from"), (hi - lo).cast("int").alias("len"),
                    F.slice("ids", from_doc.cast("int") + 1, (hi - lo).cast("int")).alias("ids"))


def pack_windows(tok: DataFrame, spec: PackSpec, by: list[str], order: str) -> DataFrame:
    """W2 + X4: ``(*by, file_no, win, input_ids, n_pieces, first_<order>,
    last_<order>)``, one row per full window (tails dropped)."""
    wp = window_pieces(tok, spec, by, order)
    g = wp.groupBy(*by, "file_no", "win").agg(
        F.array_sort(F.collect_list(F.struct("win_offset", "ids"))).alias("parts"),
        F.sum("len").alias("n"), F.count("*").alias("n_pieces"),
        F.min_by(order, "win_offset").alias(f"first_{order}"),
        F.max_by(order, "win_offset").alias(f"last_{order}"))
    return (g.filter(F.col("n") == spec.context)
             .select(*by, "file_no", "win", F.flatten(F.transform("parts", lambda s: s["ids"])).alias("input_ids"),
                     "n_pieces", f"first_{order}", f"last_{order}"))


def narrow_ids(ids: Column | str = "ids") -> Column:
    """``struct<small array<smallint>, wide array<int>>``: ids under 32,768
    take half the bytes of a shuffle; a piece with a larger id stays wide."""
    c = F.col(ids) if isinstance(ids, str) else ids
    fits = F.coalesce(F.array_max(c) < 1 << 15, F.lit(True))
    return F.struct(F.when(fits, c.cast("array<smallint>")).alias("small"), F.when(~fits, c).alias("wide"))


def full_ids(narrow: Column | Mapping[str, Column]) -> Column:
    """The ids of ``narrow_ids``."""
    return F.coalesce(narrow["small"].cast("array<int>"), narrow["wide"])


def _assemble(parts: Column | str) -> Column:
    return F.flatten(F.transform(F.array_sort(parts), lambda s: s["ids"]))


def write_windows(tok: DataFrame, spec: PackSpec, by: list[str], order: str, path: str) -> DataFrame:
    """W2 as a written table, with one shuffle of the token data.

    The offset step leaves pieces hash-partitioned by (stream, bucket), and
    a group-by on (stream, bucket, file, window) reuses that partitioning.
    So job 1 assembles every window that lies inside one bucket where its
    pieces already are, and writes it (``kind=whole``) together with the
    fragments of windows cut by a bucket boundary (``kind=cut``, at most one
    window per boundary). Job 2 reads only the fragments (partition
    pruning), merges them by (stream, file, window) in a small shuffle, and
    appends the full ones (``kind=merged``). Returns the windows as written:
    ``(*by, file_no, win, input_ids, n_pieces, first_<order>, last_<order>)``.
    Compared with ``pack_windows``, it saves the shuffle of all pieces by
    window; it pays for it with a write, which a pipeline that keeps its
    windows does anyway."""
    spark = tok.sparkSession
    C = spec.context
    wp = window_pieces(tok, spec, by, order, keep_bucket=True)
    g = wp.groupBy(*by, SB, "file_no", "win").agg(
        F.collect_list(F.struct("win_offset", "ids")).alias("parts"),
        F.sum("len").alias("n"), F.count("*").alias("n_pieces"),
        F.min("win_offset").alias("lo"), F.max("win_offset").alias("hi"),
        F.min_by(order, "win_offset").alias("first"), F.max_by(order, "win_offset").alias("last"))
    whole = F.col("n") == C
    staged = g.select(*by, "file_no", "win",
                      F.when(whole, _assemble("parts")).alias("input_ids"),
                      F.when(~whole, F.col("parts")).alias("parts"),
                      F.col("n").cast("bigint").alias("n"), F.col("n_pieces").cast("bigint").alias("n_pieces"),
                      "lo", "hi", "first", "last",
                      F.when(whole, F.lit("whole")).otherwise(F.lit("cut")).alias("kind"))
    # ``kind`` is a plain column: a partitioned write would sort every row
    # (with its ids) by it; job 2 reads only the small columns instead
    staged.write.mode("overwrite").parquet(f"{path}/stage")
    cut = spark.read.parquet(f"{path}/stage").select(*by, "file_no", "win", "parts", "n", "n_pieces",
                                                     "lo", "hi", "first", "last", "kind") \
        .where(F.col("kind") == "cut")
    merged = cut.groupBy(*by, "file_no", "win").agg(
        F.flatten(F.collect_list("parts")).alias("parts"), F.sum("n").alias("n"),
        F.sum("n_pieces").alias("n_pieces"), F.min_by("first", "lo").alias("first"),
        F.max_by("last", "hi").alias("last")).filter(F.col("n") == C)
    cols = [*by, "file_no", "win", "input_ids", "n_pieces", "first", "last"]
    merged.select(*by, "file_no", "win", _assemble("parts").alias("input_ids"), "n_pieces", "first", "last") \
        .write.mode("overwrite").parquet(f"{path}/merged")
    out = spark.read.parquet(f"{path}/stage").where(F.col("kind") == "whole").select(*cols) \
        .unionByName(spark.read.parquet(f"{path}/merged").select(*cols))
    return out.withColumnRenamed("first", f"first_{order}").withColumnRenamed("last", f"last_{order}")


def training_samples(windows: DataFrame) -> DataFrame:
    """F11 + F12: ``input_ids`` and ``labels`` (a copy) widened to bigint."""
    ids = F.col("input_ids").cast("array<bigint>")
    return windows.withColumn("input_ids", ids).withColumn("labels", ids)


def file_table(stats: DataFrame, prefix: Column | str, shard: str = "shard") -> DataFrame:
    """Shard files as ``(file_name, prefix, shard, file_no, num_tokens,
    num_special_tokens)``."""
    pre = F.col(prefix) if isinstance(prefix, str) else prefix
    return stats.select(names.shard_file_name(pre, F.col(shard), F.col("file_no")).alias("file_name"),
                        pre.alias("prefix"), F.col(shard).alias("shard"), "file_no",
                        "num_tokens", "num_special_tokens")


def sample_counts(files: DataFrame, context: int, by: list[str] = ()) -> DataFrame:
    """samples = sum over files of ``num_tokens div C``."""
    s = F.expr(f"num_tokens div {int(context)}")
    if by:
        return files.groupBy(*by).agg(F.sum(s).cast("bigint").alias("samples"),
                                      F.sum(s * context).cast("bigint").alias("sample_tokens"))
    return files.agg(F.sum(s).cast("bigint").alias("samples"),
                     F.sum(s * context).cast("bigint").alias("sample_tokens"))
