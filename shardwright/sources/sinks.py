"""Sinks: chat Parquet, token-shard files (export / import) and the
done-file manifest.

Token-shard file layout: see ``shard_source``, which is also their Spark
data source.
"""

from __future__ import annotations

import struct
import uuid
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names
from .shard_source import DTYPES, HEADER_FORMAT, HEADER_SIZE, INT32_MAX, MAGIC, VERSION, parse_header
from .storage import open_input, open_random, resolve

DTYPE_CODES = {name: code for code, name in enumerate(DTYPES)}
READ_TOKENS = 1 << 22  # ids held by one output batch of the importer


def write_chat(df: DataFrame, path: str, max_file_bytes: int = 400 * 1024 * 1024,
               partition: str = "dataset_name") -> DataFrame:
    """``(id, text, chat)`` Parquet files named
    ``NNN_<dataset>_NNNNN.parquet`` (the dataset's place in name order, then
    the file's number), each of about ``max_file_bytes``. Rows stay spread
    over tasks: AQE's rebalance splits a dataset of any size. Files are
    written to a staging folder and renamed when all are complete. Returns
    the written table, ``dataset_name`` read back from the file names."""
    from .readers import read_parquet
    spark = df.sparkSession
    size = F.octet_length("text") * 2 + F.lit(64)
    rows = F.greatest(F.lit(1), F.floor(F.lit(float(max_file_bytes)) / F.avg(size))).cast("bigint")
    per_file = df.agg(rows).first()[0] or 1
    staging = f"{path}/_staging-{uuid.uuid4().hex}"
    (df.select("id", "text", "chat", F.col(partition).alias("__ds")).hint("rebalance", "__ds")
       .write.option("maxRecordsPerFile", per_file).partitionBy("__ds").parquet(staging))
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(staging)
    store = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for k, folder in enumerate(sorted((d.getPath() for d in store.listStatus(base) if d.isDirectory()), key=lambda p: p.getName())):
        name = unquote(folder.getName().partition("=")[2])
        parts = sorted((f.getPath() for f in store.listStatus(folder) if f.getPath().getName().endswith(".parquet")), key=lambda p: p.getName())
        for i, f in enumerate(parts):
            target = jvm.org.apache.hadoop.fs.Path(path, names.CHAT_NAME_FORMAT % (k, name, i))
            if not store.rename(f, target):
                raise OSError(f"cannot rename {f} to {target}")
    store.delete(base, True)
    back = read_parquet(spark, path, pattern="*.parquet").select("*", F.col("_metadata.file_path").alias("__f"))
    return back.withColumn(partition, names.dataset_name("__f")).drop("__f")


def _write_files(out_dir: str, dtype: str):
    """mapInArrow body: rows sorted by (file_name, file_offset) arrive in
    Arrow batches with the file's totals; each run of rows of one file is
    written with one slice of the batch's flat id buffer, behind a header
    from the totals. Files are streams, so any store will do; a file gets
    its name when it is complete, and a retried or speculative attempt
    writes under a name of its own and replaces it with the same bytes."""
    import pyarrow as pa
    np_dtype = np.dtype(dtype).newbyteorder("<")
    code = DTYPE_CODES[dtype]

    def run(batches):
        store, root = resolve(out_dir)
        st = {"cur": None, "fh": None}
        done = []

        def close():
            if st["fh"] is None:
                return
            st["fh"].close()
            store.move(st["tmp"], f"{root}/{st['cur']}")
            done.append((st["cur"], st["ntok"], st["nspec"]))
            st["fh"] = None

        def open_file(name, ntok, nspec):
            close()
            if ntok > INT32_MAX:
                raise ValueError(f"{name}: {ntok} tokens do not fit the header")
            st.update(cur=name, ntok=ntok, nspec=nspec, tmp=f"{root}/.{name}.{uuid.uuid4().hex}.tmp")
            st["fh"] = store.open_output_stream(st["tmp"], compression=None)
            st["fh"].write(struct.pack(HEADER_FORMAT, MAGIC, VERSION, ntok, nspec, code))

        for batch in batches:
            names_ = batch.column("file_name").to_pylist()
            ids = batch.column("ids")
            offs = ids.offsets.to_numpy()
            vals = ids.values.to_numpy(zero_copy_only=False)
            i, n = 0, len(names_)
            while i < n:
                j = i
                while j + 1 < n and names_[j + 1] == names_[i]:
                    j += 1
                if names_[i] != st["cur"]:
                    open_file(names_[i], batch.column("num_tokens")[i].as_py(), batch.column("num_special_tokens")[i].as_py())
                st["fh"].write(vals[offs[i]:offs[j + 1]].astype(np_dtype).tobytes())
                i = j + 1
        close()
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()),
                 pa.array([d[2] for d in done], pa.int64())],
                names=["file_name", "num_tokens", "num_special_tokens"])
    return run


def export_shards(pieces: DataFrame, out_dir: str, prefix: str = "source", shard: str = "shard",
                  dtype: str = "i4", narrow: bool = False) -> DataFrame:
    """K1 / K3: write ``prefix-UUU-CCCCC.data`` files from the shard pieces
    (``pack_shards``). The pieces of a file meet in one task (hash by file
    name; AQE merges small partitions) in offset order and are streamed to
    its file; with ``narrow``, ids are shuffled in 16 bits where they fit.
    Returns ``(file_name, num_tokens, num_special_tokens)``; the export runs
    when that is evaluated. ``out_dir`` is any folder or URI that
    all executors share; a file that is there already is replaced, so a
    second run into one folder needs other file numbers (``next_file_no``)."""
    from ..operators.packing import full_ids, narrow_ids
    spark = pieces.sparkSession
    p = pieces.select(names.shard_file_name(F.col(prefix), F.col(shard), F.col("file_no")).alias("file_name"),
                      "file_offset", "piece_len", "num_special_tokens", narrow_ids("ids").alias("ids") if narrow else "ids")
    whole = Window.partitionBy("file_name")
    p = p.repartition("file_name").select(
        "file_name", "file_offset", "ids", F.sum("piece_len").over(whole).cast("bigint").alias("num_tokens"),
        F.sum("num_special_tokens").over(whole).cast("bigint").alias("num_special_tokens"))
    p = p.sortWithinPartitions("file_name", "file_offset")
    if narrow:
        p = p.withColumn("ids", full_ids(F.col("ids")))
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(out_dir)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
    return p.mapInArrow(_write_files(out_dir, dtype),
                        "file_name string, num_tokens long, num_special_tokens long")


def next_file_no(done: DataFrame, by: str = "prefix", shard: str = "shard") -> DataFrame:
    """Next free file number per prefix and writer part, from the names of
    files that are already there: ``(prefix, shard, next_no)``."""
    base = names.basename("file_name")
    n = F.regexp_extract(base, r"-(\d{3,})-(\d{5,})\.data$", 2).cast("bigint")
    u = F.regexp_extract(base, r"-(\d{3,})-(\d{5,})\.data$", 1).cast("bigint")
    return done.select(names.shard_prefix("file_name").alias(by), u.alias(shard), n.alias("n")) \
        .groupBy(by, shard).agg((F.max("n") + 1).alias("next_no"))


def _read_headers(batches):
    for pdf in batches:
        rows = []
        for path in pdf["path"]:
            with open_input(path) as f:
                raw = f.read(HEADER_SIZE)
            rows.append((path, *parse_header(path, raw)))
        yield pd.DataFrame(rows, columns=["path", "num_tokens", "num_special_tokens", "dtype"])


def shard_headers(spark: SparkSession, root: str, pattern: str = "*.data") -> DataFrame:
    """Validated headers ``(path, num_tokens, num_special_tokens, dtype)``
    of the shard files (20 bytes read per file)."""
    from .readers import list_files
    # the listing holds one short row per file: a task per core is plenty
    files = list_files(spark, root, pattern).select("path").coalesce(spark.sparkContext.defaultParallelism)
    return files.mapInPandas(_read_headers, "path string, num_tokens long, num_special_tokens long, dtype string")


def _read_ranges(batches):
    """mapInArrow body: each ``(path, start, count)`` range is one seek and
    one read; ids go out in batches of bounded size, without pandas objects."""
    import pyarrow as pa

    def out(batch, rows, chunks):
        offsets = np.zeros(len(chunks) + 1, dtype=np.int32)
        np.cumsum([len(c) for c in chunks], out=offsets[1:])
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(chunks)))
        return pa.RecordBatch.from_arrays([batch.column("path").take(pa.array(rows)), batch.column("chunk_no").take(pa.array(rows)), ids],
                                          names=["path", "chunk_no", "ids"])

    for batch in batches:
        cols = batch.to_pydict()
        rows, chunks, held = [], [], 0
        for i, (path, dtype, start, count) in enumerate(zip(cols["path"], cols["dtype"], cols["start"], cols["count"])):
            dt = np.dtype(dtype).newbyteorder("<")
            with open_random(path) as f:
                raw = f.read_at(int(count) * dt.itemsize, HEADER_SIZE + int(start) * dt.itemsize)
            rows.append(i)
            chunks.append(np.frombuffer(raw, dt).astype(np.int32))
            held += len(chunks[-1])
            if held > READ_TOKENS:
                yield out(batch, rows, chunks)
                rows, chunks, held = [], [], 0
        if rows:
            yield out(batch, rows, chunks)


def import_shards(spark: SparkSession, root: str, chunk_tokens: int, pattern: str = "*.data") -> DataFrame:
    """Token arrays of shard files as ``(path, chunk_no, ids)`` chunks of
    ``chunk_tokens`` (the last one shorter): the header table is exploded
    into ``(path, start, count)`` ranges and each task seeks to its ranges,
    so no task reads a whole file."""
    h = shard_headers(spark, root, pattern)
    n_chunks = F.greatest(F.ceil(F.col("num_tokens") / chunk_tokens), F.lit(0)).cast("bigint")
    r = h.filter(F.col("num_tokens") > 0).withColumn(
        "chunk_no", F.explode(F.sequence(F.lit(0).cast("bigint"), n_chunks - 1)))
    r = r.withColumn("start", F.col("chunk_no") * chunk_tokens) \
        .withColumn("count", F.least(F.lit(chunk_tokens), F.col("num_tokens") - F.col("start")))
    return r.select("path", "dtype", "chunk_no", "start", "count").repartition("path", "chunk_no").mapInArrow(
        _read_ranges, "path string, chunk_no long, ids array<int>")


# --- done-file manifest (K4 / J1) -------------------------------------------------

def signature(path_col) -> F.Column:
    """F8: SHA-256 hex of the input path."""
    c = F.col(path_col) if isinstance(path_col, str) else path_col
    return F.sha2(c.cast("string"), 256)


def new_files(files: DataFrame, manifest: DataFrame, path: str = "path") -> DataFrame:
    """Input files not in the manifest (by path signature)."""
    return files.withColumn("sig", signature(path)).join(manifest.select("sig"), "sig", "left_anti")


def append_manifest(done: DataFrame, manifest_path: str, path: str = "path", batch: str | None = None) -> None:
    """K4: record finished inputs; called after their output is written,
    so a failure before this point re-processes them (never loses them).
    Each batch has a folder of its own: writing a named ``batch`` again
    replaces its rows."""
    done.select(signature(path).alias("sig"), F.col(path).alias("path"),
                F.current_timestamp().alias("committed_at")) \
        .write.mode("overwrite").parquet(f"{manifest_path}/batch={batch or uuid.uuid4().hex}")


def read_manifest(spark: SparkSession, manifest_path: str) -> DataFrame:
    from .readers import path_exists
    schema = "sig string, path string, committed_at timestamp"
    if path_exists(spark, manifest_path):
        return spark.read.option("recursiveFileLookup", True).schema(schema).parquet(manifest_path)
    return spark.createDataFrame([], schema)
