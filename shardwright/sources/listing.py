"""File listing by tasks, for folders with more files than the driver may
hold. Spark's own listing brings a status of every file to the driver and
keeps it as long as the table that reads the files.

The folders of a level are dealt over tasks; what they hold is written to the
scratch folder, and its folders are the next level. A folder is listed by one
task, in batches on a file system, at once in another store.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator, Sequence
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .storage import resolve

STORES = ("file", "hdfs", "s3", "gs")  # that tasks can open, see ``storage``
ROWS = 4096           # entries per output batch
FOLDERS_PER_TASK = 16
_SCHEMA = "root string, path string, length bigint, is_folder boolean"
_UNSAFE = re.compile(r'[\x00-\x20"<>\\^`{|}%#?\[\]\x7f]|[^\x00-\x7f]')


def _quoted(path: str) -> str:
    """A path as Spark's ``_metadata.file_path`` writes it."""
    def one(m):
        c = m[0]
        return quote(c) if c < "\x80" or unicodedata.category(c) in ("Zs", "Zl", "Zp", "Cc") else c
    return _UNSAFE.sub(one, path)


def uri_of(root: str, path: str) -> str:
    """Spark's name of a file that the store of ``root`` calls ``path``."""
    u = urlsplit(root)
    if u.scheme == "file":
        return "file:" + _quoted(path)
    return f"{u.scheme}://{'' if u.scheme in ('s3', 'gs') else u.netloc}{_quoted(path)}"


def qualified(spark: SparkSession, root: str | Sequence[str]) -> list[str] | None:
    """The folders with their scheme; None if tasks can't list one of them or
    it isn't there (Spark's reader then does or says so)."""
    jvm, conf, out = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for r in [root] if isinstance(root, str) else root:
        if re.search(r"[*?\[\]{}\\]", r):
            return None
        path = jvm.org.apache.hadoop.fs.Path(r)
        store = path.getFileSystem(conf)
        path = store.makeQualified(path)
        if path.toUri().getScheme() not in STORES or not store.exists(path):
            return None
        out.append(path.toString())
    return out


def _entries(root: str, folder: str) -> Iterator[tuple[str, int, bool]]:
    store, _ = resolve(root)
    if isinstance(store, fs.LocalFileSystem):
        if not os.path.isdir(folder):
            yield folder, os.path.getsize(folder), False
            return
        with os.scandir(folder) as found:
            for e in found:
                is_folder = e.is_dir()
                yield e.path, 0 if is_folder else e.stat().st_size, is_folder
        return
    (here,) = store.get_file_info([folder])
    for i in [here] if here.type == fs.FileType.File else store.get_file_info(fs.FileSelector(folder)):
        yield i.path, i.size or 0, i.type == fs.FileType.Directory


def _hidden(name: str) -> bool:
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _list(suffixes: tuple[str, ...]):
    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.bool_()))],
                                          names=["root", "path", "length", "is_folder"])

    def run(batches):
        rows = []
        for b in batches:
            for r in b.to_pylist():
                for path, length, is_folder in _entries(r["root"], r["path"]):
                    name = path.rsplit("/", 1)[-1]
                    if not _hidden(name) and (is_folder or name.endswith(suffixes)):
                        rows.append((r["root"], path, length, is_folder))
                    if len(rows) >= ROWS:
                        yield batch(rows)
                        rows = []
        if rows:
            yield batch(rows)
    return run


def list_by_tasks(spark: SparkSession, roots: Sequence[str], suffixes: Sequence[str]) -> DataFrame:
    """``(root, path, length)`` of the files under the ``qualified`` roots
    whose names have one of the suffixes; ``path`` is their store's name."""
    level, n, files = spark.createDataFrame([(r, resolve(r)[1]) for r in roots], "root string, path string"), len(roots), []
    while n:
        tasks = max(min(n, spark.sparkContext.defaultParallelism), -(-n // FOLDERS_PER_TASK))
        found = materialize(spark, level.repartition(tasks, "path").mapInArrow(_list(tuple(suffixes)), _SCHEMA), "listing")
        files.append(found.filter("NOT is_folder").select("root", "path", "length"))
        level = found.filter("is_folder").select("root", "path")
        n = level.count()
    out = files[0]
    for f in files[1:]:
        out = out.unionByName(f)
    return out
