"""Corpus readers: file listing, Parquet / JSON Lines / JSON array /
tar.gz / whole-file text, with file paths and row positions.

All of them are Spark readers; Python runs only where a format has no Spark
reader (tar members, pretty printing), inside ``mapInPandas`` or an Arrow
UDF, one archive or one batch per call.
"""

from __future__ import annotations

import json
import re
import tarfile
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordering import ordinal, running_sum, with_range_bucket
from ..session import SMALL_FILE_COST, small_file_session
from . import listing
from .storage import open_input, resolve

# File patterns of each reader format; a folder is read with
# the union of its format's patterns.
PATTERN_MAP = {
    "parquet": ["*.parquet"],
    "jsonl": ["*.jsonl", "*json", "*.json.gz", "*.jsonl.gz", "*.json.tar.gz", "*.jsonl.tar.gz"],
    "xml": ["*.xml"],
    "json": ["*.json"],
    "text": ["*.txt", "*.json", "*.xml"],
}


_PLAIN_TEXT = (".txt", ".json", ".xml")
WHOLE_BYTES, WHOLE_ROWS = 4 << 20, 1024  # of whole files, per output batch

# JSON Lines files that are not archives
PLAIN_JSONL = "{*.jsonl,*json,*.json.gz,*.jsonl.gz}"


def glob_filter(fmt: str) -> str:
    """One brace glob for a format; an unknown format raises."""
    if fmt not in PATTERN_MAP:
        raise ValueError(f"unknown corpus format {fmt!r}; known: {', '.join(sorted(PATTERN_MAP))}")
    pats = PATTERN_MAP[fmt]
    return pats[0] if len(pats) == 1 else "{" + ",".join(pats) + "}"


def list_files(spark: SparkSession, root: str | Sequence[str], pattern: str) -> DataFrame:
    """Recursive listing ``(path, length, modificationTime)`` of the
    files under ``root`` whose name matches ``pattern``. Spark lists in
    parallel and never opens the files (the content column is pruned)."""
    r = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
         .option("pathGlobFilter", pattern).load(root))
    return r.select("path", "length", "modificationTime")


def _reader(spark: SparkSession, pattern: str | None, recursive: bool = True):
    r = spark.read.option("recursiveFileLookup", recursive)
    return r.option("pathGlobFilter", pattern) if pattern else r


def with_path(df: DataFrame, out: str = "file_path") -> DataFrame:
    return df.withColumn(out, F.col("_metadata.file_path"))


def read_parquet(spark: SparkSession, root, pattern: str | None = "*.parquet",
                 columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet; selecting columns prunes the scan."""
    df = _reader(spark, pattern).parquet(*([root] if isinstance(root, str) else root))
    return df.select(*columns) if columns else df


def read_jsonl(spark: SparkSession, root, schema, pattern: str | None = None,
               mode: str = "FAILFAST") -> DataFrame:
    """JSON Lines, plain or ``.gz`` (by extension); a bad line fails the
    job (``FAILFAST``) or, with ``PERMISSIVE``, lands in ``_corrupt_record``."""
    return _reader(spark, pattern).schema(schema).option("mode", mode).json(root)


def read_json_array(spark: SparkSession, root, schema, pattern: str | None = "*.json") -> DataFrame:
    """Files holding one JSON array of records (whole file per task); a
    broken file fails the job (``bad_json_files`` lists such files)."""
    return _reader(spark, pattern).schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(root)


def read_json_positions(spark: SparkSession, root, schema: str, pattern: str | None = "*.json",
                        pos: str = "id_in_file", skip_bad: bool = False) -> DataFrame:
    """JSON array files with each record's position in its array
    (``multiLine`` JSON loses it). A file that is not a JSON array, or an
    item that does not fit ``schema``, fails the job; ``skip_bad`` leaves
    such files out instead (``bad_json_files`` lists them)."""
    t = _reader(spark, pattern).text(root, wholetext=True).select(
        F.col("_metadata.file_path").alias("file_path"), "value")
    parsed = F.from_json("value", "array<string>")
    if not skip_bad:
        parsed = F.when(parsed.isNull(), F.raise_error(F.concat(F.lit("not a JSON array: "), "file_path")).cast("array<string>")).otherwise(parsed)
    items = t.select("file_path", F.posexplode(parsed).alias(pos, "__item"))
    return items.select("file_path", F.col(pos).cast("bigint").alias(pos),
                        F.from_json("__item", schema, {"mode": "FAILFAST"}).alias("r")).select("file_path", pos, "r.*")


def bad_json_files(spark: SparkSession, root, pattern: str | None = "*.json") -> DataFrame:
    """Q7: JSON array files that do not parse."""
    t = _reader(spark, pattern).text(root, wholetext=True).select(
        F.col("_metadata.file_path").alias("file_path"), "value")
    return t.filter(F.from_json("value", "array<string>").isNull()).select("file_path")


def read_jsonl_positions(spark: SparkSession, root, schema, pattern: str | None = None,
                         pos: str = "id_in_file") -> DataFrame:
    """JSON Lines with each line's 0-based position in its file. Lines
    of a file are ordered by (split start, row id within the split), and the
    position is a two-level ordinal over those splits, so a large file is
    not sorted in one task."""
    df = read_jsonl(spark, root, schema, pattern).select(
        "*", F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__row"))
    return ordinal(df, ["__block", "__row"], by=["file_path"], bucket=F.col("__block"), out=pos) \
        .drop("__block", "__row")


def read_parquet_positions(spark: SparkSession, root, pattern: str | None = "*.parquet",
                           pos: str = "id_in_file") -> DataFrame:
    """Parquet rows with ``file_path`` and each row's 0-based position,
    taken from the file's own row index (no shuffle)."""
    df = _reader(spark, pattern).parquet(root)
    return df.select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias(pos))


def default_id(path: str = "file_path", pos: str = "id_in_file"):
    """``path/position``."""
    return F.concat_ws("/", F.col(path), F.col(pos).cast("string"))


def skip_limit(df: DataFrame, order: Sequence[str], skip: int = 0, limit: int = -1,
               bucket=None) -> DataFrame:
    """Rows ``skip .. skip + limit`` of the reader's order, by a
    distributed ordinal (no single-partition sort of the remainder)."""
    return _slice(ordinal(df, list(order), bucket=bucket, out="__ord"), skip, limit)


def skip_limit_by_file(df: DataFrame, file: str, pos: str = "id_in_file", skip: int = 0, limit: int = -1) -> DataFrame:
    """S12 / L1 for rows that know their position in their file: rows
    ``skip .. skip + limit`` in (``file``, ``pos``) order. Only the row
    counts per file are ordered; the rows are filtered where they are."""
    counts = with_range_bucket(df.groupBy(file).agg(F.count("*").alias("__n")), [file])
    base = running_sum(counts, "__n", [file], bucket=F.col("__rbucket"), out="__start").select(F.col(file).alias("__file"), "__start")
    x = df.join(base, F.col(file).eqNullSafe(F.col("__file"))).withColumn("__ord", F.col("__start") + F.col(pos))
    return _slice(x, skip, limit).drop("__start", "__file")


def _slice(df: DataFrame, skip: int, limit: int) -> DataFrame:
    cond = F.col("__ord") >= skip
    if limit >= 0:
        cond = cond & (F.col("__ord") < skip + limit)
    return df.filter(cond).drop("__ord")


# --- tar.gz archives ---------------------------------------------------------

def _tar_lines(member_suffix: str, as_array: bool, batch_rows: int = 4096):
    """mapInPandas body: stream the wanted members of each archive, a batch
    of lines at a time (a member is never held whole, except a JSON array,
    which has to be parsed whole)."""
    cols = ["file_path", "member", "id_in_file", "line"]

    def members(tar):
        for m in tar:
            if m.isfile() and m.name.endswith(member_suffix):
                f = tar.extractfile(m)
                if f is not None:
                    yield m.name, f

    def lines_of(f):
        if as_array:
            for x in json.loads(f.read().decode("utf-8")):
                yield json.dumps(x, ensure_ascii=False)
        else:
            for raw in f:
                ln = raw.decode("utf-8").strip()
                if ln:
                    yield ln

    def run(batches):
        import pandas as pd
        buf = []
        for pdf in batches:
            for path in pdf["path"]:
                with open_input(path) as raw, tarfile.open(fileobj=raw, mode="r|gz") as tar:
                    for name, f in members(tar):
                        with f:
                            for i, ln in enumerate(lines_of(f)):
                                buf.append((path, name, i, ln))
                                if len(buf) >= batch_rows:
                                    yield pd.DataFrame(buf, columns=cols)
                                    buf = []
        if buf:
            yield pd.DataFrame(buf, columns=cols)
    return run


def read_tar(spark: SparkSession, root, schema: str, member_suffix: str = ".jsonl",
             pattern: str = "*.tar.gz", as_array: bool = False) -> DataFrame:
    """JSON Lines (or JSON array) members of ``.tar.gz`` archives;
    members not ending in ``member_suffix`` are skipped. One archive per
    task: the listing is hash-partitioned by path, and each task streams
    its archives' members in batches."""
    files = list_files(spark, root, pattern).select("path")
    n = max(1, files.count())   # the listing: one row per archive
    lines = files.repartition(n, "path").mapInPandas(
        _tar_lines(member_suffix, as_array), "file_path string, member string, id_in_file long, line string")
    # a line that is not JSON fails the job, as in the plain reader
    return lines.select("file_path", "member", "id_in_file", F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r")) \
        .select("file_path", "member", "id_in_file", "r.*")


# --- whole-file text ----------------------------------------------------------

def _pretty_one(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        return json.dumps(json.loads(text), indent=4)
    except ValueError:
        pass
    try:
        import xml.dom.minidom
        import xml.etree.ElementTree as ET
        ET.fromstring(text)
        return xml.dom.minidom.parseString(text).toprettyxml(indent="  ")
    except Exception:  # noqa: BLE001 - not XML: the raw text
        return text


@F.arrow_udf(T.StringType())
def pretty_text(texts: pa.Array) -> pa.Array:
    """JSON re-printed with indent 4 (ASCII escapes), else XML
    pretty-printed, else the text itself."""
    return pa.array([_pretty_one(t) for t in texts.to_pylist()], type=pa.string())


def _plain_suffixes(pattern: str | None) -> list[str] | None:
    """The endings a pattern asks for, if it asks for those of files stored
    plain and nothing else."""
    parts = pattern.strip("{}").split(",") if pattern else []
    ok = parts and all(re.fullmatch(r"\*[\w.-]+", p) and p.endswith(_PLAIN_TEXT) for p in parts)
    return [p[1:] for p in parts] if ok else None


def _read_whole(skip_bad: bool, skip_missing: bool):
    """mapInArrow body: the files' bytes in batches of bounded size."""
    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.binary()))], names=["file_path", "content"])

    def run(batches):
        stores, rows, held = {}, [], 0
        for b in batches:
            for r in b.to_pylist():
                root = r["root"]
                if root not in stores:
                    stores[root] = resolve(root)[0]
                try:
                    with stores[root].open_input_stream(r["path"], compression=None) as f:
                        data = f.read()
                except FileNotFoundError:
                    if not skip_missing:
                        raise
                    continue
                except OSError:
                    if not skip_bad:
                        raise
                    continue
                rows.append((listing.uri_of(root, r["path"]), data))
                held += len(data)
                if held >= WHOLE_BYTES or len(rows) >= WHOLE_ROWS:
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)
    return run


def _whole_files(spark: SparkSession, roots: Sequence[str], suffixes: Sequence[str]) -> DataFrame:
    """``(file_path, value)`` of plain files that tasks list, deal out and
    read: the driver holds none of their names."""
    files = listing.list_by_tasks(spark, roots, suffixes)
    n, size = files.agg(F.count("*"), F.coalesce(F.sum(F.col("length") + SMALL_FILE_COST), F.lit(0))).first()
    most = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    tasks = max(1, min(n, spark.sparkContext.defaultParallelism), -(-size // most))
    on = lambda key: spark.conf.get(f"spark.sql.files.{key}", "false").lower() == "true"
    got = files.repartition(tasks, F.xxhash64("path")).mapInArrow(
        _read_whole(on("ignoreCorruptFiles"), on("ignoreMissingFiles")), "file_path string, content binary")
    return got.select("file_path", F.col("content").cast("string").alias("value"))


def read_whole_text(spark: SparkSession, root, pattern: str | None = None, pretty: bool = True) -> DataFrame:
    """One row per file ``(file_path, text)``; unreadable files are
    skipped when ``spark.sql.files.ignoreCorruptFiles`` is on. A task reads
    about two thousand small files. Files that the pattern says are stored
    plain are listed and read as bytes by tasks (``listing``): Spark's reader
    holds the status of every file on the driver, and its text reader sets up
    a job and all codecs for each file, which costs more than reading it.
    Other files, and stores that tasks can't open, go through Spark's reader,
    which leaves out files of no bytes."""
    suffixes = _plain_suffixes(pattern)
    roots = listing.qualified(spark, root) if suffixes else None
    if roots:
        t = _whole_files(spark, roots, suffixes).select("file_path", F.col("value").alias("text"))
        return t.withColumn("text", pretty_text("text")) if pretty else t
    r = _reader(small_file_session(spark), pattern)
    if suffixes:
        t = r.format("binaryFile").load(root).withColumn("value", F.col("content").cast("string"))
    else:
        t = r.text(root, wholetext=True)
    t = t.select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("text"))
    # the rows belong to the caller's session, whose views and settings hold for what follows
    t = spark.createDataFrame([], "file_path string, text string").unionByName(t)
    return t.withColumn("text", pretty_text("text")) if pretty else t


# --- cached split tables -------------------------------------------------------

def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def cached_splits(spark: SparkSession, base: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Reuse ``base/train`` and ``base/validation`` when both were
    written; else build the table (with a ``split`` column), write both,
    and read them back (which also cuts the lineage)."""
    tr, va = f"{base}/train", f"{base}/validation"
    if not (path_exists(spark, f"{tr}/_SUCCESS") and path_exists(spark, f"{va}/_SUCCESS")):
        df = build()
        df.filter(F.col("split") == "train").drop("split").write.mode("overwrite").parquet(tr)
        df.filter(F.col("split") == "validation").drop("split").write.mode("overwrite").parquet(va)
    return (spark.read.parquet(tr).withColumn("split", F.lit("train"))
            .unionByName(spark.read.parquet(va).withColumn("split", F.lit("validation"))))


# --- format dispatch (S8 / S17) ----------------------------------------------------

FORMATS = ("parquet", "jsonl", "json", "text", "xml")


def read_format(spark: SparkSession, root, fmt: str, schema=None, fn: Callable[[DataFrame], DataFrame] | None = None,
                where=None) -> DataFrame:
    """Read a folder the way its format handler does; ``fn`` is the row map
    (E1) and ``where`` the row filter (a map returning nothing drops the
    row). ``jsonl`` also reads ``.gz`` files and the ``.jsonl`` members of
    ``.tar.gz`` archives; ``json`` files hold arrays; ``text``/``xml`` give
    one pretty-printed ``text`` row per file. An unknown format raises."""
    pattern = glob_filter(fmt)
    if fmt == "parquet":
        df = read_parquet(spark, root, pattern=pattern)
    elif fmt == "jsonl":
        if schema is None:
            raise ValueError("jsonl needs a schema")
        plain = read_jsonl(spark, root, schema, pattern=PLAIN_JSONL)
        tar = read_tar(spark, root, schema if isinstance(schema, str) else schema.simpleString(),
                       member_suffix=".jsonl", pattern="{*.json.tar.gz,*.jsonl.tar.gz}")
        df = plain.unionByName(tar.drop("file_path", "member", "id_in_file"), allowMissingColumns=True)
    elif fmt == "json":
        if schema is None:
            raise ValueError("json needs a schema")
        df = read_json_array(spark, root, schema, pattern=pattern)
    else:
        df = read_whole_text(spark, root, pattern=pattern).select("text")
    if fn is not None:
        df = df.transform(fn)
    return df.where(where) if where is not None else df
