"""Position index of JSON Lines files: rows and byte offsets per file split.

``build_index`` reads the files once and writes a small table, one row per
split (32 MB of a plain file, a whole compressed file): where its first line
begins, where its last one ends, how many rows it holds and the position of
the first of them in its file and in the whole reading order. Every later
reader takes positions from that table: no row is shuffled to be numbered, and
``skip`` / ``limit`` open only splits that hold wanted rows.

A split owns the lines that begin in it. Lines of white space only are no
rows. A missing row in the index is a file that was not there when it was
built; build it again after files were added.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import order_key
from ..operators import documents
from ..operators.ordering import running_sum, with_range_bucket
from .readers import default_id, list_files
from .storage import open_random, resolve

SPLIT_BYTES = 32 << 20
CHUNK = 1 << 20
BATCH_ROWS, BATCH_BYTES = 4096, 4 << 20
MAX_TASKS = 20_000
_ENDINGS = {".gz": "gzip", ".zst": "zstd", ".bz2": "bz2"}  # by file name, as Spark's readers do


def _chunks(path: str, start: int, codec: str | None) -> Iterator[bytes]:
    if codec:
        store, name = resolve(path)
        stream = store.open_input_stream(name, compression=codec)
    else:
        stream = open_random(path)
        stream.seek(start)
    with stream:
        while chunk := stream.read(CHUNK):
            yield chunk


def own_lines(path: str, start: int, length: int, codec: str | None) -> Iterator[tuple[int, bytes]]:
    """``(byte offset, line)`` of the lines that begin in ``start`` ..
    ``start + length``; offsets of a compressed file are of its content.
    Holds a chunk and the line at its end."""
    stop = None if codec else start + length
    at, rest = start, b""
    skip = start > 0  # the line that begins before belongs to the split before
    if skip:
        at -= 1
    for chunk in _chunks(path, at, codec):
        lines = (rest + chunk).split(b"\n")
        rest = lines.pop()
        for line in lines:
            if skip:
                skip = False
            elif stop is not None and at >= stop:
                return
            else:
                yield at, line
            at += len(line) + 1
        if stop is not None and at >= stop:
            return
    if rest and not skip and (stop is None or at < stop):
        yield at, rest


def _spread(splits: DataFrame, start: str) -> DataFrame:
    """About a task for each split, up to ``MAX_TASKS``. The number is given:
    by the few bytes of their rows Spark would put all splits into one task."""
    return splits.repartition(max(1, min(splits.count(), MAX_TASKS)), F.xxhash64("file_path", start))


def _count(batches):
    names = ["file_path", "start", "codec", "byte_start", "byte_end", "n_rows"]
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            first, end, n = r["start"], r["start"], 0
            for at, line in own_lines(r["file_path"], r["start"], r["length"], r["codec"]):
                if line.strip():
                    first, n = (at if n == 0 else first), n + 1
                    end = at + len(line)
            out.append((r["file_path"], r["start"], r["codec"], first, end, n))
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()])], names=names)


def build_index(spark: SparkSession, root, out: str, pattern: str = "{*.jsonl,*json,*.json.gz,*.jsonl.gz}",
                split_bytes: int = SPLIT_BYTES, shuffle_seed=None, compression: str | None = "infer",
                order: Column | None = None) -> DataFrame:
    """Write the index of the files under ``root`` to ``out`` and return it:
    ``file_path, start, codec, byte_start, byte_end, n_rows, first_in_file,
    first_row``. Files are read in name order, in that of ``order`` (over
    ``file_path``), or, with ``shuffle_seed``, in that of the seeded file
    shuffle. ``compression`` names the codec of all files, ``infer`` goes by
    their names."""
    codec = F.lit(compression).cast("string")
    if compression == "infer":
        codec = F.coalesce(*[F.when(F.col("file_path").endswith(e), F.lit(c)) for e, c in _ENDINGS.items()])
    files = list_files(spark, root, pattern).select(F.col("path").alias("file_path"), "length").withColumn("codec", codec)
    starts = F.when(F.col("codec").isNull() & (F.col("length") > 0), F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(split_bytes).cast("bigint"))) \
        .otherwise(F.array(F.lit(0).cast("bigint")))
    splits = files.select("file_path", "length", "codec", F.explode(starts).alias("start"))
    splits = splits.withColumn("length", F.least(F.lit(split_bytes), F.col("length") - F.col("start")))
    counted = _spread(splits.select("file_path", "start", "length", "codec"), "start").mapInArrow(
        _count, "file_path string, start bigint, codec string, byte_start bigint, byte_end bigint, n_rows bigint")
    rank = order_key(shuffle_seed, F.col("file_path")) if shuffle_seed is not None else order if order is not None else F.lit(0)
    keys = ["file_rank", "file_path", "start"]
    placed = with_range_bucket(counted.withColumn("file_rank", rank), keys)
    placed = running_sum(placed, "n_rows", keys, bucket=F.col("__rbucket"), out="first_row").drop("__rbucket")
    # rows of one file only: its splits, 32 MB each
    before = F.min("first_row").over(Window.partitionBy("file_path"))
    placed.withColumn("first_in_file", F.col("first_row") - before).drop("file_rank").write.parquet(out)
    return spark.read.parquet(out)


def wanted_splits(index: DataFrame, skip: int = 0, limit: int = -1) -> DataFrame:
    """Splits that hold rows ``skip`` .. ``skip + limit`` of the reading
    order, with the part of each: rows ``lo`` to ``hi`` (exclusive)."""
    hi = F.col("n_rows")
    if limit >= 0:
        hi = F.least(hi, F.lit(skip + limit) - F.col("first_row"))
    x = index.withColumn("lo", F.greatest(F.lit(0).cast("bigint"), F.lit(skip) - F.col("first_row"))).withColumn("hi", hi)
    return x.filter("lo < hi")


def _read(batches):
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
    names = ["file_path", "id_in_file", "position", "value"]

    def block(r, first, lines):
        n = len(lines)
        cols = [[r["file_path"]] * n, range(r["first_in_file"] + first, r["first_in_file"] + first + n),
                range(r["first_row"] + first, r["first_row"] + first + n), [x.decode("utf-8") for x in lines]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    for batch in batches:
        for r in batch.to_pylist():
            lines, size, k = [], 0, 0
            for _, line in own_lines(r["file_path"], r["byte_start"], r["byte_end"] - r["byte_start"], r["codec"]) if r["codec"] is None \
                    else own_lines(r["file_path"], 0, 0, r["codec"]):
                if not line.strip():
                    continue
                if k >= r["hi"]:
                    break
                k += 1
                if k <= r["lo"]:
                    continue
                lines.append(line)
                size += len(line)
                if len(lines) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield block(r, k - len(lines), lines)
                    lines, size = [], 0
            if lines:
                yield block(r, k - len(lines), lines)


def read_lines(index: DataFrame, skip: int = 0, limit: int = -1) -> DataFrame:
    """``file_path, id_in_file, position, value`` of the wanted rows; only
    their splits are opened, and no row is shuffled."""
    cols = ["file_path", "codec", "byte_start", "byte_end", "first_in_file", "first_row", "lo", "hi"]
    return _spread(wanted_splits(index, skip, limit).select(*cols), "byte_start").mapInArrow(
        _read, "file_path string, id_in_file bigint, position bigint, value string")


def read_rows(index: DataFrame, schema: str, skip: int = 0, limit: int = -1) -> DataFrame:
    """``file_path, id_in_file, position`` and the record's
    columns. A line that does not fit ``schema`` fails the job."""
    r = F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")
    return read_lines(index, skip, limit).select("file_path", "id_in_file", "position", r).select("file_path", "id_in_file", "position", "r.*")


def read_documents(index: DataFrame, schema: str, dataset_name: str | None = None, text_key: str = "text", id_key: str = "id",
                   default_metadata: dict[str, str] | None = None, skip: int = 0, limit: int = -1) -> DataFrame:
    """Documents ``(id, text, media, metadata, dataset_name)`` and their
    ``position``. ``text_key`` and ``id_key`` name the record's columns, a
    record without id takes ``path/position in its file``, and
    ``default_metadata`` holds for keys that the record does not have."""
    rows = read_rows(index, schema, skip, limit).withColumnRenamed("file_path", "__path").withColumnRenamed("id_in_file", "__at")
    adapted = documents.adapt(rows, dataset_name, text_key, id_key, default_id=default_id("__path", "__at"),
                              keep=["position"], drop=["__path", "__at", "position"])
    if not default_metadata:
        return adapted
    base = F.create_map(*[F.lit(x) for kv in default_metadata.items() for x in kv])
    return adapted.withColumn("metadata", documents.merge_metadata(base, F.col("metadata")))
