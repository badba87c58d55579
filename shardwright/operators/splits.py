"""Train / validation splits of files and of rows.

File tables are small (one row per shard file of hundreds of MB), so a
window per corpus over files is cheap; row splits rank rows with the
two-level ordinal so that no file or corpus is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import order_key
from .ordering import bucket_hex, count_by, ordinal


def rank_files(files: DataFrame, seed, name: str = "file_name", by: Sequence[str] = (),
               out: str = "rank") -> DataFrame:
    """1-based rank of each file in the seeded shuffle
    (``md5(seed:name)``, ties by name) within ``by``."""
    # a two-level ordinal bucketed on the hash prefix: no step holds the
    # whole file list, only the (at most 65536-row) bucket table is global
    x = files.withColumn("__key", order_key(seed, F.col(name)))
    x = ordinal(x, ["__key", name], by=list(by), bucket=bucket_hex("__key", 4), out=out)
    return x.withColumn(out, (F.col(out) + 1).cast("bigint")).drop("__key")


def split_rate(files: DataFrame, validation_rate: float, seed, name: str = "file_name",
               by: Sequence[str] = ()) -> DataFrame:
    """``n_train = min(n - 1, floor(n * (1 - rate)))`` files by seeded
    rank go to train, the rest to validation; fails unless both sides get a
    file."""
    r = count_by(rank_files(files, seed, name, by), by, "__n")
    n_train = F.least(F.col("__n") - 1, F.floor(F.col("__n") * F.lit(1.0 - validation_rate)))
    check = F.when(n_train >= 1, n_train).otherwise(
        F.raise_error(F.lit("split needs at least one training and one validation file")))
    return r.withColumn("split", F.when(F.col("rank") <= check, F.lit("train")).otherwise(F.lit("validation"))) \
        .drop("__n")


def split_config(files: DataFrame, config: DataFrame, seed, corpus: str = "corpus",
                 name: str = "file_name") -> DataFrame:
    """Per corpus of ``config(corpus, type, train, validation)``:
    ``number`` counts or ``rate`` shares (``floor(n * rate)``); validation
    defaults to the remaining files; the sample (seeded, without
    replacement) is cut at ``train`` or, with no validation files, at
    ``train - 1``; more files asked for than exist is an error. Files of
    corpora not in the config are dropped. ``files`` holds ``corpus``."""
    c = config.select(corpus, "type", F.col("train").cast("double").alias("c_train"),
                      F.col("validation").cast("double").alias("c_val"))
    r = count_by(rank_files(files, seed, name, [corpus]), [corpus], "__n")
    r = r.join(F.broadcast(c), on=corpus, how="inner")   # config: one row per configured corpus
    n = F.col("__n")
    train = F.when(F.col("type") == "number", F.col("c_train")).otherwise(F.floor(n * F.col("c_train")))
    val = F.when(F.col("c_val").isNull(), n - train).when(
        F.col("type") == "number", F.col("c_val")).otherwise(F.floor(n * F.col("c_val")))
    r = r.withColumn("__train", train.cast("bigint")).withColumn("__val", val.cast("bigint"))
    total = F.col("__train") + F.col("__val")
    total_ok = F.when(total <= n, total).otherwise(F.raise_error(F.concat(
        F.lit("not enough files for "), F.col(corpus))))
    cut = F.when(F.col("__val") <= 0, F.col("__train") - 1).otherwise(F.col("__train"))
    split = F.when(F.col("rank") <= cut, F.lit("train")).when(F.col("rank") <= total_ok, F.lit("validation"))
    return r.withColumn("split", split).filter(F.col("split").isNotNull()) \
        .drop("__n", "__train", "__val", "type", "c_train", "c_val")


def split_by_folder(files: DataFrame, path: str = "path") -> DataFrame:
    """``split`` from a ``/train/`` or ``/validation/`` folder in the path."""
    p = F.col(path)
    return files.withColumn("split", F.when(p.contains("/validation/"), F.lit("validation"))
                            .when(p.contains("/train/"), F.lit("train")))


def split_rows(df: DataFrame, rate: float, seed, id_col: str, by: Sequence[str] = ("file",)) -> DataFrame:
    """T4: in each ``by`` group (a file), ``ceil(n * rate)`` rows of the
    seeded shuffle go to validation, the rest to train."""
    key = order_key(seed, F.col(id_col))
    x = df.withColumn("__key", key)
    x = ordinal(x, ["__key", id_col], by=list(by), bucket=bucket_hex("__key", 4), out="__pos")
    x = count_by(x, list(by), "__n")
    n_val = F.ceil(F.col("__n") * F.lit(float(rate)))
    return x.withColumn("split", F.when(F.col("__pos") < n_val, F.lit("validation")).otherwise(F.lit("train"))) \
        .drop("__key", "__pos", "__n")


def prefix_match(files: DataFrame, config: DataFrame, corpus: str = "corpus",
                 name: str = "file_name") -> DataFrame:
    """Files whose base name starts with a configured prefix; a
    file may match two prefixes. Each name gives one key for every length a
    prefix has (a level of the prefixes' trie), and the keys meet the config
    in an equality join: no nested loop over the config. Null names and null
    prefixes match nothing; the empty prefix matches every name."""
    base = F.regexp_extract(F.col(name), r"([^/]*)$", 1)
    lengths = config.agg(F.array_sort(F.collect_set(F.length(corpus)))).scalar()
    keyed = files.withColumn("__n", F.explode(lengths)).filter(F.col("__n") <= F.length(base)) \
        .withColumn("__key", F.substr(base, F.lit(1), F.col("__n")))
    return keyed.join(config, F.col("__key") == F.col(corpus), "inner").drop("__key", "__n")


def missing_corpora(files_matched: DataFrame, config: DataFrame, corpus: str = "corpus") -> DataFrame:
    """Configured corpora with no file (warned and skipped)."""
    return config.join(files_matched.select(corpus).distinct(), on=corpus, how="left_anti")



def choose_split(files: DataFrame, seed, *, untokenized_config: DataFrame | None = None,
                 folder_split: bool = False, config: DataFrame | None = None,
                 validation_rate: float = 0.005, name: str = "file_name") -> DataFrame:
    """T5: the reference's order of split routes: an untokenized-corpus
    config, else ``train/`` and ``validation/`` folders, else a corpus
    config (prefix match), else a rate split of all files."""
    if untokenized_config is not None:
        from ..functions.names import dataset_name
        f = files.withColumn("corpus", dataset_name(F.col(name))).filter(F.col("corpus").isNotNull())
        return split_config(f, untokenized_config, seed, name=name)
    if folder_split:
        return split_by_folder(files.withColumn("path", F.col(name))).filter(F.col("split").isNotNull())
    if config is not None:
        return split_config(prefix_match(files, config.select("corpus"), name=name), config, seed, name=name)
    return split_rate(files, validation_rate, seed, name=name)
