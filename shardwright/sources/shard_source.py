"""Token-shard ``.data`` files as a Spark data source.

    register(spark)
    spark.read.format("token_shards").option("chunk_tokens", 2048).load(folder)
    laid_out.write.format("token_shards").mode("append").save(folder)

Reading plans byte ranges from the file listing alone: a large file is cut
into ranges, small files share one. A task reads the header of each file it
touches, and the chunks that begin in its range.

Writing is a two-phase commit. A task streams its files into a staging folder
of the job under the target; the driver moves them to their names when every
task has finished. A task that fails removes what it wrote, and a job that
fails removes the staging folder, so readers never see part of a job's files.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions import names
from .storage import resolve

FORMAT = "token_shards"
# A 20-byte little-endian header of magic, version, num_tokens,
# num_special_tokens and dtype code (0 = int16, 1 = int32, 2 = int64), then
# the token array.
HEADER_FORMAT = "<4siiii"
HEADER_SIZE = struct.calcsize(HEADER_FORMAT)   # 20
MAGIC = b"XLLM"
VERSION = 1
DTYPES = ("i2", "i4", "i8")  # the code is the place
INT32_MAX = 2**31 - 1

READ_SCHEMA = "path string, chunk_no bigint, start bigint, ids array<int>"
WRITE_COLUMNS = ("file_name", "file_offset", "num_tokens", "num_special_tokens", "ids")
BATCH_TOKENS = 1 << 20  # ids held by one output batch of the reader


def parse_header(path: str, raw: bytes) -> tuple[int, int, str]:
    """``(num_tokens, num_special_tokens, dtype)``; anything else raises."""
    fields = struct.unpack(HEADER_FORMAT, raw) if len(raw) == HEADER_SIZE else None
    if fields is None or fields[:2] != (MAGIC, VERSION) or fields[4] not in range(len(DTYPES)):
        raise ValueError(f"{path} does not start with a token-shard header (found {raw!r})")
    return fields[2], fields[3], DTYPES[fields[4]]


@dataclass
class ByteRanges(InputPartition):
    """``(path, first byte, end byte)`` ranges of one task."""

    ranges: list


def plan_ranges(files: list[tuple[str, int]], split_bytes: int) -> list[list[tuple[str, int, int]]]:
    """Ranges of at most ``split_bytes``, several small ones to a task. Every
    byte behind a header is in one range; a file without tokens is in one
    too, so that its header is checked."""
    parts: list[list] = []
    part, held = [], 0
    for path, size in sorted(files):
        at = 0
        while True:
            end = min(at + split_bytes, size)
            if part and held + end - at > split_bytes:
                parts.append(part)
                part, held = [], 0
            part.append((path, at, end))
            held += end - at
            at = end
            if at >= size:
                break
    return parts + ([part] if part else [])


class ShardReader(DataSourceReader):
    def __init__(self, root: str, suffix: str, chunk_tokens: int, split_bytes: int):
        self.root, self.suffix, self.chunk, self.split_bytes = root, suffix, chunk_tokens, split_bytes

    def partitions(self):
        store, base = resolve(self.root)
        info = store.get_file_info(base)
        if info.type == fs.FileType.File:
            found = [info]
        else:
            found = store.get_file_info(fs.FileSelector(base, recursive=True))
        lead = self.root[:len(self.root) - len(base)] if self.root.endswith(base) else ""
        hidden = ("_", ".")
        keep = [f for f in found if f.type == fs.FileType.File and f.base_name.endswith(self.suffix)
                and not any(p.startswith(hidden) for p in f.path[len(base):].split("/") if p)]
        return [ByteRanges(r) for r in plan_ranges([(lead + f.path, f.size) for f in keep], self.split_bytes)] or [ByteRanges([])]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for path, lo, hi in partition.ranges:
            store, name = resolve(path)
            with store.open_input_file(name) as f:
                total, _, dtype = parse_header(path, f.read_at(HEADER_SIZE, 0))
                kind = np.dtype(dtype).newbyteorder("<")
                if f.size() != HEADER_SIZE + total * kind.itemsize:
                    raise ValueError(f"{path} has {f.size()} bytes, its header says {total} tokens")
                step = self.chunk * kind.itemsize
                no = max(0, -(-(lo - HEADER_SIZE) // step))  # the first chunk that begins in the range
                while HEADER_SIZE + no * step < hi and no * self.chunk < total:
                    n = min(self.chunk, total - no * self.chunk)
                    raw = f.read_at(n * kind.itemsize, HEADER_SIZE + no * step)
                    rows.append((path, no, no * self.chunk, np.frombuffer(raw, kind).astype(np.int32)))
                    held += n
                    no += 1
                    if held >= BATCH_TOKENS:
                        yield self._batch(rows)
                        rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows) -> pa.RecordBatch:
        offsets = np.zeros(len(rows) + 1, np.int32)
        np.cumsum([len(r[3]) for r in rows], out=offsets[1:])
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([r[3] for r in rows])))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64()),
                                           pa.array([r[2] for r in rows], pa.int64()), ids], names=["path", "chunk_no", "start", "ids"])


@dataclass
class Written(WriterCommitMessage):
    """Names of the files a task has staged."""

    files: list


class ShardWriter(DataSourceArrowWriter):
    """Streams rows of ``WRITE_COLUMNS`` (a file's rows together, in offset
    order) into staged files and moves them when the job commits."""

    def __init__(self, root: str, dtype: str, overwrite: bool):
        self.root, self.dtype, self.overwrite = root, dtype, overwrite
        self.stage = f"_staging-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, base = resolve(self.root)
        own = f"{base}/{self.stage}/{uuid.uuid4().hex}"  # an attempt has its own folder
        store.create_dir(own, recursive=True)
        kind = np.dtype(self.dtype).newbyteorder("<")
        limit = np.iinfo(kind)
        done: list[str] = []
        now = None  # (name, declared tokens, written tokens, stream)

        def close():
            if now is not None:
                now[3].close()
                if now[1] != now[2]:
                    raise ValueError(f"{now[0]}: {now[2]} tokens came, its rows say {now[1]}")
                done.append(f"{own}/{now[0]}")

        try:
            for batch in batches:
                name = batch.column("file_name").to_pylist()
                ids = batch.column("ids")
                offs, vals = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
                start = batch.column("file_offset").to_pylist()
                for i, n in enumerate(name):
                    if now is None or n != now[0]:
                        close()
                        total, special = batch.column("num_tokens")[i].as_py(), batch.column("num_special_tokens")[i].as_py()
                        if total > INT32_MAX:
                            raise ValueError(f"{n}: {total} tokens do not fit the header")
                        now = [n, total, 0, store.open_output_stream(f"{own}/{n}", compression=None)]
                        now[3].write(struct.pack(HEADER_FORMAT, MAGIC, VERSION, total, special, DTYPES.index(self.dtype)))
                    if start[i] != now[2]:
                        raise ValueError(f"{n}: a piece at {start[i]} came after {now[2]} tokens")
                    part = vals[offs[i]:offs[i + 1]]
                    if len(part) and (part.min() < limit.min or part.max() > limit.max):
                        raise ValueError(f"{n}: an id does not fit {self.dtype}")
                    now[3].write(part.astype(kind).tobytes())
                    now[2] += len(part)
            close()
        except BaseException:
            if now is not None and not now[3].closed:
                now[3].close()
            store.delete_dir(own)
            raise
        return Written(done)

    def commit(self, messages) -> None:
        store, base = resolve(self.root)
        staged = [f for m in messages if m is not None for f in m.files]
        target = {f: f"{base}/{f.rsplit('/', 1)[1]}" for f in staged}
        if len(set(target.values())) != len(staged):
            raise ValueError("rows of one file came from several tasks")
        old = [f.path for f in store.get_file_info(fs.FileSelector(base)) if f.type == fs.FileType.File and f.base_name.endswith(".data")]
        if not self.overwrite and (clash := sorted(set(old) & set(target.values()))):
            raise FileExistsError(f"{clash[0]} is there already; use other file numbers or mode overwrite")
        with ThreadPoolExecutor(16) as pool:  # renames only
            list(pool.map(lambda f: store.move(f, target[f]), staged))
            if self.overwrite:
                list(pool.map(store.delete_file, set(old) - set(target.values())))
        self._clear(store, base)

    def abort(self, messages) -> None:
        self._clear(*resolve(self.root))

    def _clear(self, store, base) -> None:
        if store.get_file_info(f"{base}/{self.stage}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/{self.stage}")


class TokenShards(DataSource):
    """Options: ``path``; read ``chunk_tokens`` (ids a row, default 2048),
    ``suffix`` (default ``.data``), ``split_bytes`` (default 128 MiB); write
    ``dtype`` (``i2``, ``i4`` or ``i8``, default ``i4``)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> ShardReader:
        return ShardReader(self.options["path"], self.options.get("suffix", ".data"), int(self.options.get("chunk_tokens", 2048)),
                           int(self.options.get("split_bytes", 128 << 20)))

    def writer(self, schema, overwrite: bool) -> ShardWriter:
        missing = [c for c in WRITE_COLUMNS if c not in schema.fieldNames()]
        if missing:
            raise ValueError(f"{FORMAT} needs the columns {', '.join(WRITE_COLUMNS)}; missing: {', '.join(missing)}")
        dtype = self.options.get("dtype", "i4")
        if dtype not in DTYPES:
            raise ValueError(f"unknown dtype {dtype!r}; known: {', '.join(DTYPES)}")
        return ShardWriter(self.options["path"], dtype, overwrite)


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(TokenShards)
    return spark


def lay_out(pieces: DataFrame, prefix: str = "source", shard: str = "shard") -> DataFrame:
    """Rows for the writer from the shard pieces of ``packing.pack_shards``:
    a file's pieces meet in one task, in offset order, with the file's
    totals. A file holds a bounded number of tokens, however long its
    stream is."""
    p = pieces.select(names.shard_file_name(F.col(prefix), F.col(shard), F.col("file_no")).alias("file_name"), "file_offset", "piece_len", "num_special_tokens", "ids")
    totals = p.groupBy("file_name").agg(F.sum("piece_len").cast("bigint").alias("num_tokens"), F.sum("num_special_tokens").cast("bigint").alias("num_special_tokens"))
    rows = p.drop("num_special_tokens", "piece_len").join(totals, "file_name").select(*WRITE_COLUMNS)
    # by a hash of its own, so that the exchange is not merged with one below it
    return rows.repartition(F.xxhash64("file_name")).sortWithinPartitions("file_name", "file_offset")
