"""Session helpers: a tuned local session for tests and benches, and the
shared scratch folder every job writes its intermediate tables to."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SMALL_FILE_COST = 64 << 10   # bytes a file counts for besides its length


def local_session(cpus: int | str = "*", app: str = "shardwright",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """A local session with the settings we rely on (AQE, UTC, no UI).

    On a cluster the caller builds the session; nothing here is required
    there except ``spark.checkpoint.dir`` pointing at shared storage.
    """
    n = shuffle_partitions or (8 if cpus == "*" else max(int(cpus), 1))
    b = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(n))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.driver.memory", "16g")
         .config("spark.sql.files.maxPartitionBytes", str(64 << 20)))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return ``spark.checkpoint.dir``; set a private one only when it is
    unset and the master is local (tests). A cluster must name a shared
    folder itself: a machine-local folder would be lost with its executor."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if d:
        return d
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    d = tempfile.mkdtemp(prefix="shardwright-ckpt-")
    spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return spark.sparkContext.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused folder under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    if base.startswith("file:"):
        base = base[len("file:"):]
    return os.path.join(base, "scratch", f"{name}-{uuid.uuid4().hex[:12]}")


def materialize(spark: SparkSession, df, name: str):
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: later branches read only the columns they need, expensive
    upstream work (a tokenizer) runs once, and a lost executor does not
    send the job back to the raw input."""
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


@contextmanager
def written_meanwhile(spark: SparkSession, df, name: str) -> Iterator:
    """``materialize`` for the length of a block: the table is deleted at its
    end, also when the block fails."""
    path = scratch_path(spark, name)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    try:
        df.write.option("compression", "zstd").parquet(path)
        yield spark.read.parquet(path)
    finally:
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """In the block, the shuffle files of each execution go when it ends.
    Otherwise they stay until the driver happens to collect its garbage, so
    the disk holds those of every step of a job at once."""
    before = spark.conf.get(REMOVE_SHUFFLES, None)
    spark.conf.set(REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(REMOVE_SHUFFLES)
        else:
            spark.conf.set(REMOVE_SHUFFLES, before)


def small_file_session(spark: SparkSession) -> SparkSession:
    """A session with the settings of ``spark`` whose file scans count little
    for opening a file. Spark counts 4 MB a file, so a task reads 32 files
    however small they are and costs more than their reading."""
    small = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if small.conf.isModifiable(k):
            small.conf.set(k, v)
    small.conf.set("spark.sql.files.openCostInBytes", str(SMALL_FILE_COST))
    return small
