"""File-name functions: shard file names and the corpus names read back from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name formats.
# token shard file:   <prefix>-UUU-CCCCC.data  (UUU = writer part, CCCCC = file number)
# chat parquet file:  NNN_<dataset>_NNNNN.parquet
SHARD_NAME_FORMAT = "%s-%03d-%05d.data"
CHAT_NAME_FORMAT = "%03d_%s_%05d.parquet"
SHARD_NAME_RE = r"^(.+)-\d{3}-\d{5}\.data$"
DATASET_NAME_RE = r"^\d+_(.*?)_\d+\.parquet"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def basename(path: Column | str) -> Column:
    return F.regexp_extract(_c(path), r"([^/]*)$", 1)


def shard_file_name(prefix, shard, file_no) -> Column:
    """K3: ``prefix-UUU-CCCCC.data``."""
    return F.format_string(SHARD_NAME_FORMAT, _c(prefix), _c(shard).cast("int"), _c(file_no).cast("int"))


def shard_prefix(path: Column | str, strict: bool = True) -> Column:
    """corpus prefix of a shard file (basename only); an ill-formed name
    raises when ``strict``, else gives NULL."""
    name = basename(path)
    p = F.regexp_extract(name, SHARD_NAME_RE, 1)
    if not strict:
        return F.nullif(p, F.lit(""))
    return F.when(p != "", p).otherwise(
        F.raise_error(F.concat(F.lit("not a token-shard file name: "), name)))


def dataset_name(path: Column | str) -> Column:
    """dataset of ``N_name_N.parquet`` (match anchored at the start), else NULL."""
    return F.nullif(F.regexp_extract(basename(path), DATASET_NAME_RE, 1), F.lit(""))
