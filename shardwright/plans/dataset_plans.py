"""Queries over shard files: splits, shuffles, weights, mixing, reader
shards and resume. The files are the ones ``pack_shards`` writes for the
corpora of ``documents`` (prefix = ``source``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import hash52, order_key
from ..operators import mixing, packing, sharding, splits
from ..operators.ordering import bucket_hex, count_by, ordinal
from ..session import materialize
from . import packing_plans as pp
from .registry import query

SEED = 1234
C = pp.SPEC.context

# DuckDB: the shard files (name, prefix, num_tokens) from token counts only.
_FILES = f"""
fd AS (SELECT doc_id, source, doc_id % {pp.SPEC.shards} AS shard, strlen(text) + 1 AS n FROM documents),
fo AS (SELECT *, (sum(n) OVER (PARTITION BY source, shard ORDER BY doc_id
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n)::BIGINT AS start FROM fd),
ff AS (SELECT *, unnest(generate_series(start // {pp.SPEC.file_tokens},
                                        (start + n - 1) // {pp.SPEC.file_tokens})) AS file_no FROM fo),
files AS (
  SELECT printf('%s-%03d-%05d.data', source, shard, file_no) AS file_name, source AS prefix, shard, file_no,
         sum(least(start + n, (file_no + 1) * {pp.SPEC.file_tokens})
             - greatest(start, file_no * {pp.SPEC.file_tokens}))::BIGINT AS num_tokens
  FROM ff GROUP BY ALL)"""


def _ok(seed, x):
    return f"md5('{seed}:' || {x})"


def files(spark, sf_dir):
    """The shard-file table (one small row per file), written once so the
    queries that use it several times do not re-run the packing."""
    return materialize(spark, packing.file_table(pp.stats(spark, sf_dir), "source"), "files")


def samples(files_df):
    """One row per training sample of each file (W5: ``num_tokens div C``)."""
    return files_df.filter(F.col("num_tokens") >= C).withColumn("win", F.explode(F.sequence(
        F.lit(0).cast("bigint"), (F.floor(F.col("num_tokens") / C) - 1).cast("bigint"))))


@query("shuffle_files", sql=f"""
WITH {_FILES}
SELECT file_name, row_number() OVER (ORDER BY {_ok(SEED, 'file_name')}, file_name) AS rank FROM files""")
def q_shuffle_files(spark, sf_dir):
    return splits.rank_files(files(spark, sf_dir), SEED).select("file_name", "rank")


@query("split_rate", sql=f"""
WITH {_FILES},
r AS (SELECT file_name, prefix, row_number() OVER (PARTITION BY prefix ORDER BY {_ok(SEED, 'file_name')}, file_name) AS rank,
             count(*) OVER (PARTITION BY prefix) AS n FROM files)
SELECT file_name, prefix, rank,
       CASE WHEN rank <= least(n - 1, floor(n * (1 - 0.1::DOUBLE))) THEN 'train' ELSE 'validation' END AS split
FROM r""")
def q_split_rate(spark, sf_dir):
    return splits.split_rate(files(spark, sf_dir), 0.1, SEED, by=["prefix"]) \
        .select("file_name", "prefix", "rank", "split")


# corpus config of the config split and of explicit weights: prefix matching
# is by ``startswith`` (src1 also takes src10..src19); zzz has no files.
CONFIG = [
    # corpus, type, train, validation, train_weight, validation_weight
    ("src0", "number", 1.0, None, 2.0, None),
    ("src1", "rate", 0.5, None, 1.0, 3.0),
    ("src2", "rate", 0.6, 0.2, 0.5, None),
    ("src3", "rate", 1.0, None, 1.5, 1.0),
    ("src4", "number", 1.0, 0.0, 1.0, None),
    ("zzz", "rate", 0.5, None, 1.0, None),
]
CONFIG_SCHEMA = ("corpus string, type string, train double, validation double, "
                 "train_weight double, validation_weight double")
_CONFIG_SQL = "config AS (SELECT * FROM (VALUES " + ", ".join(
    "('{}', '{}', {}::DOUBLE, {}, {}::DOUBLE, {})".format(
        c, t, tr, "NULL::DOUBLE" if v is None else f"{v}::DOUBLE", tw, "NULL::DOUBLE" if vw is None else f"{vw}::DOUBLE")
    for c, t, tr, v, tw, vw in CONFIG) + ") AS t(corpus, type, train, validation, train_weight, validation_weight))"


def config(spark):
    return spark.createDataFrame(CONFIG, CONFIG_SCHEMA)


@query("split_config", sql=f"""
WITH {_FILES}, {_CONFIG_SQL},
m AS (SELECT f.file_name, c.* FROM files f JOIN config c ON starts_with(f.file_name, c.corpus)),
r AS (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY {_ok(SEED, 'file_name')}, file_name) AS rank,
             count(*) OVER (PARTITION BY corpus) AS n FROM m),
k AS (SELECT *, (CASE WHEN type = 'number' THEN train ELSE floor(n * train) END)::BIGINT AS n_train FROM r),
v AS (SELECT *, (CASE WHEN validation IS NULL THEN n - n_train WHEN type = 'number' THEN validation
                      ELSE floor(n * validation) END)::BIGINT AS n_val FROM k)
SELECT file_name, corpus, rank,
       CASE WHEN rank <= (CASE WHEN n_val <= 0 THEN n_train - 1 ELSE n_train END) THEN 'train' ELSE 'validation' END AS split
FROM v WHERE rank <= n_train + n_val""")
def q_split_config(spark, sf_dir):
    m = splits.prefix_match(files(spark, sf_dir), config(spark).select("corpus"))
    return splits.split_config(m, config(spark), SEED).select("file_name", "corpus", "rank", "split")


@query("split_by_folder", sql=f"""
WITH {_FILES}
SELECT file_name, CASE WHEN shard = 0 THEN 'validation' ELSE 'train' END AS split FROM files""")
def q_split_by_folder(spark, sf_dir):
    f = files(spark, sf_dir)
    p = F.concat_ws("/", F.lit("corpus"), F.when(F.col("shard") == 0, F.lit("validation")).otherwise(F.lit("train")),
                    F.col("file_name"))
    return splits.split_by_folder(f.withColumn("path", p)).select("file_name", "split")


@query("files_by_prefix", sql=f"""
WITH {_FILES}, {_CONFIG_SQL}
SELECT c.corpus, count(*) AS n_files, sum(num_tokens)::BIGINT AS num_tokens,
       sum(('0x' || substr(md5(f.file_name), 1, 13))::BIGINT::HUGEINT)::VARCHAR AS files_hash,
       count(DISTINCT f.prefix) AS n_prefixes
FROM files f JOIN config c ON starts_with(f.file_name, c.corpus) GROUP BY c.corpus""")
def q_files_by_prefix(spark, sf_dir):
    m = splits.prefix_match(files(spark, sf_dir), config(spark))
    return m.groupBy("corpus").agg(
        F.count("*").alias("n_files"), F.sum("num_tokens").cast("bigint").alias("num_tokens"),
        # order-independent and distributive (no list of names per corpus):
        # exact sum of the 52-bit hash of each name
        F.sum(hash52(F.md5("file_name")).cast("decimal(38,0)")).cast("string").alias("files_hash"),
        F.count_distinct("prefix").alias("n_prefixes"))


@query("config_missing", sql=f"""
WITH {_FILES}, {_CONFIG_SQL}
SELECT corpus FROM config c WHERE NOT EXISTS (SELECT 1 FROM files f WHERE starts_with(f.file_name, c.corpus))""")
def q_config_missing(spark, sf_dir):
    m = splits.prefix_match(files(spark, sf_dir), config(spark))
    return splits.missing_corpora(m, config(spark)).select("corpus")


@query("name_prefix", sql=f"""
WITH {_FILES}
SELECT regexp_extract(file_name, '^(.+)-\\d{{3}}-\\d{{5}}\\.data$', 1) AS prefix, count(*) AS n_files
FROM files GROUP BY 1""")
def q_name_prefix(spark, sf_dir):
    from ..functions import names
    f = files(spark, sf_dir).select(F.concat(F.lit("a/b/"), F.col("file_name")).alias("path"))
    return f.groupBy(names.shard_prefix("path").alias("prefix")).agg(F.count("*").alias("n_files"))


@query("mix_weights", sql=f"""
WITH {_FILES},
s AS (SELECT prefix AS corpus, sum(num_tokens // {C})::BIGINT AS samples FROM files GROUP BY prefix)
SELECT corpus, samples, samples::DOUBLE / (SELECT sum(samples) FROM s)::DOUBLE AS weight FROM s""")
def q_mix_weights(spark, sf_dir):
    s = packing.sample_counts(files(spark, sf_dir), C, ["prefix"]).select(
        F.col("prefix").alias("corpus"), "samples")
    return mixing.weights_by_count(s, "samples")


def _corpus_samples(spark, sf_dir):
    """Samples of each corpus in reading order (files by seeded rank, then window)."""
    f = splits.rank_files(files(spark, sf_dir), SEED, by=["prefix"])
    s = samples(f).withColumnRenamed("prefix", "corpus")
    return ordinal(s, ["rank", "win"], by=["corpus"], bucket=F.col("rank"), out="position")


_CORPUS_SAMPLES = f"""
rf AS (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY {_ok(SEED, 'file_name')}, file_name) AS rank FROM files),
sm AS (SELECT prefix AS corpus, file_name, rank, unnest(generate_series(0, num_tokens // {C} - 1)) AS win FROM rf),
cs AS (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY rank, win) - 1 AS position FROM sm),
wt AS (SELECT corpus, count(*)::DOUBLE / (SELECT count(*) FROM cs)::DOUBLE AS weight FROM cs GROUP BY corpus)"""


def _u(seed, key):
    return f"((('0x' || substr(md5('{seed}:' || {key}), 1, 13))::BIGINT + 1)::DOUBLE / 4503599627370497::DOUBLE)"


_ARRIVAL = f"""
g AS (SELECT cs.*, floor(-ln({_u(SEED, "cs.corpus || ':' || cs.position")}) / wt.weight * 1000000::DOUBLE)::BIGINT AS gap
      FROM cs JOIN wt USING (corpus)),
a AS (SELECT *, sum(gap) OVER (PARTITION BY corpus ORDER BY position
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS arrival FROM g)"""


@query("mix_weighted", sql=f"""
WITH {_FILES}, {_CORPUS_SAMPLES}, {_ARRIVAL}
SELECT corpus, position, file_name, win, arrival,
       row_number() OVER (ORDER BY arrival, corpus, position) - 1 AS mix_position FROM a""")
def q_mix_weighted(spark, sf_dir):
    s = _corpus_samples(spark, sf_dir)
    w = mixing.weights_by_count(s.groupBy("corpus").agg(F.count("*").alias("samples")), "samples")
    m = mixing.interleave(s, "corpus", "position", w, SEED)
    return m.select("corpus", "position", "file_name", "win", "arrival", "mix_position")


@query("mix_explicit", sql=f"""
WITH {_FILES}, {_CONFIG_SQL},
present AS (SELECT c.corpus, c.train_weight, coalesce(c.validation_weight, c.train_weight) AS validation_weight,
                   count(*) AS n_files
            FROM config c JOIN files f ON starts_with(f.file_name, c.corpus)
            GROUP BY c.corpus, c.train_weight, c.validation_weight)
SELECT corpus, n_files,
       train_weight / (SELECT sum(train_weight) FROM present) AS train_weight,
       validation_weight / (SELECT sum(validation_weight) FROM present) AS validation_weight
FROM present""")
def q_mix_explicit(spark, sf_dir):
    m = splits.prefix_match(files(spark, sf_dir), config(spark))
    present = m.groupBy("corpus", "train_weight", "validation_weight").agg(F.count("*").alias("n_files")) \
        .withColumn("validation_weight", F.coalesce("validation_weight", "train_weight"))
    p = mixing.normalise(present, "train_weight", "train_weight")
    p = mixing.normalise(p, "validation_weight", "validation_weight")
    return p.select("corpus", "n_files", "train_weight", "validation_weight")


N_SLOTS = 4


@query("interleave_files", sql=f"""
WITH {_FILES},
rf AS (SELECT *, row_number() OVER (ORDER BY {_ok(SEED, 'file_name')}, file_name) - 1 AS fpos FROM files),
sm AS (SELECT (fpos % {N_SLOTS})::VARCHAR AS corpus, file_name, fpos,
              unnest(generate_series(0, num_tokens // {C} - 1)) AS win FROM rf),
cs AS (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY fpos, win) - 1 AS position FROM sm),
wt AS (SELECT DISTINCT corpus, 1::DOUBLE / {N_SLOTS}::DOUBLE AS weight FROM cs),
{_ARRIVAL}
SELECT file_name, win, corpus AS slot, row_number() OVER (ORDER BY arrival, corpus, position) - 1 AS mix_position
FROM a""")
def q_interleave_files(spark, sf_dir):
    f = splits.rank_files(files(spark, sf_dir), SEED).withColumn("fpos", F.col("rank") - 1)
    f = mixing.slots(f, N_SLOTS, "fpos").withColumn("corpus", F.col("slot").cast("string"))
    s = ordinal(samples(f), ["fpos", "win"], by=["corpus"], bucket=F.col("fpos"), out="position")
    w = s.select("corpus").distinct().withColumn("weight", F.lit(1.0) / F.lit(float(N_SLOTS)))
    m = mixing.interleave(s, "corpus", "position", w, SEED)
    return m.select("file_name", "win", F.col("corpus").alias("slot"), "mix_position")


SKIP = 8 * 25   # batch size x global step (R12)


@query("resume_skip", sql=f"""
WITH {_FILES}, {_CORPUS_SAMPLES}
SELECT corpus, weight, round_even({SKIP}::DOUBLE * weight, 0)::BIGINT AS skip,
       (SELECT count(*) FROM cs WHERE cs.corpus = wt.corpus) - round_even({SKIP}::DOUBLE * weight, 0)::BIGINT AS remaining
FROM wt""")
def q_resume_skip(spark, sf_dir):
    s = _corpus_samples(spark, sf_dir)
    counts = s.groupBy("corpus").agg(F.count("*").alias("samples"))
    w = mixing.skip_allotment(mixing.weights_by_count(counts, "samples"), SKIP)
    left = mixing.apply_skip(s, w, "corpus", "position").groupBy("corpus").agg(F.count("*").alias("remaining"))
    return w.join(left, "corpus", "left").select(
        "corpus", "weight", "skip", F.coalesce("remaining", F.lit(0)).cast("bigint").alias("remaining"))


WORLD, WORKERS = 2, 3


def _readers(spark, sf_dir):
    f = splits.rank_files(files(spark, sf_dir), SEED).withColumn("position", F.col("rank") - 1)
    f = count_by(f, [], "__n")
    r = sharding.balanced_part("position", "__n", sharding.n_reader_shards(WORLD, WORKERS, False))
    return f.withColumn("reader", r).withColumn("rank_id", F.floor(F.col("reader") / WORKERS).cast("int")) \
        .withColumn("worker", (F.col("reader") % WORKERS).cast("int")).drop("__n")


_READERS = f"""
rd AS (SELECT *, row_number() OVER (ORDER BY {_ok(SEED, 'file_name')}, file_name) - 1 AS position,
              (ntile({WORLD * WORKERS}) OVER (ORDER BY {_ok(SEED, 'file_name')}, file_name) - 1)::INTEGER AS reader
       FROM files)"""


@query("shard_split", sql=f"""
WITH {_FILES}, {_READERS}
SELECT file_name, position, reader, (reader // {WORKERS})::INTEGER AS rank_id, (reader % {WORKERS})::INTEGER AS worker
FROM rd""")
def q_shard_split(spark, sf_dir):
    return _readers(spark, sf_dir).select("file_name", "position", "reader", "rank_id", "worker")


RESUME_SKIP = 100


@query("resume_position", sql=f"""
WITH {_FILES}, {_READERS},
c AS (SELECT *, num_tokens // {C} AS samples,
             sum(num_tokens // {C}) OVER (PARTITION BY reader ORDER BY position
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
             {RESUME_SKIP // WORKERS} + CASE WHEN reader % {WORKERS} = 0 THEN {RESUME_SKIP % WORKERS} ELSE 0 END AS skip
      FROM rd)
SELECT reader, file_name, position, (skip - (cum - samples))::BIGINT AS start_sample
FROM c WHERE cum - samples <= skip AND skip < cum""")
def q_resume_position(spark, sf_dir):
    r = _readers(spark, sf_dir)
    skip = sharding.worker_skip_col(RESUME_SKIP, F.col("worker"), WORKERS)
    p = sharding.resume_position(r, C, skip, by=["reader"], position="position")
    return p.select("reader", "file_name", "position", "start_sample")


@query("remaining_samples", sql=f"""
WITH {_FILES}, {_READERS}
SELECT reader, sum(num_tokens // {C})::BIGINT AS samples,
       (sum(num_tokens // {C}) - ({RESUME_SKIP // WORKERS} + CASE WHEN reader % {WORKERS} = 0 THEN {RESUME_SKIP % WORKERS} ELSE 0 END))::BIGINT AS remaining
FROM rd GROUP BY reader""")
def q_remaining_samples(spark, sf_dir):
    r = _readers(spark, sf_dir)
    g = r.groupBy("reader", "worker").agg(F.sum(F.floor(F.col("num_tokens") / C)).cast("bigint").alias("samples"))
    skip = sharding.worker_skip_col(RESUME_SKIP, F.col("worker"), WORKERS)
    return g.select("reader", "samples", (F.col("samples") - skip).cast("bigint").alias("remaining"))


@query("shuffle_rows", sql="""
SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id::VARCHAR) - 1 AS position FROM documents""")
def q_shuffle_rows(spark, sf_dir):
    d = pp.table(spark, sf_dir, "documents").select("doc_id")
    d = d.withColumn("doc_key", F.col("doc_id").cast("string"))
    return mixing.shuffle_rows(d, 42, "doc_key").select("doc_id", "position")


EPOCHS = 3


@query("epochs", sql=f"""
WITH e AS (SELECT doc_id, unnest(generate_series(0, {EPOCHS - 1})) AS epoch FROM documents)
SELECT epoch, doc_id,
       row_number() OVER (PARTITION BY epoch ORDER BY md5('42:' || epoch || ':' || doc_id),
                          epoch || ':' || doc_id) - 1 AS position
FROM e""")
def q_epochs(spark, sf_dir):
    d = mixing.repeat_epochs(pp.table(spark, sf_dir, "documents").select("doc_id"), EPOCHS)
    d = d.withColumn("__id", F.concat_ws(":", F.col("epoch").cast("string"), F.col("doc_id").cast("string")))
    d = d.withColumn("__key", order_key(42, F.col("__id")))
    return ordinal(d, ["__key", "__id"], by=["epoch"], bucket=bucket_hex("__key", 4), out="position") \
        .select("epoch", "doc_id", "position")



@query("name_dataset", sql="""
WITH f AS (SELECT doc_id,
                  CASE WHEN doc_id % 4 = 0 THEN source || '.parquet'
                       ELSE printf('%03d_%s_%05d.parquet', doc_id % 10, source || '_v' || (doc_id % 3)::VARCHAR, doc_id)
                  END AS name
           FROM documents)
SELECT doc_id, name, nullif(regexp_extract(name, '^\\d+_(.*?)_\\d+\\.parquet', 1), '') AS dataset FROM f""")
def q_name_dataset(spark, sf_dir):
    """dataset of ``N_name_N.parquet`` (lazy match, so a name holding
    ``_`` keeps it); any other name gives NULL."""
    from ..functions import names
    d = pp.table(spark, sf_dir, "documents").select("doc_id", "source")
    name = F.when(F.col("doc_id") % 4 == 0, F.concat(F.col("source"), F.lit(".parquet"))).otherwise(
        F.format_string("%03d_%s_%05d.parquet", (F.col("doc_id") % 10).cast("int"),
                        F.concat(F.col("source"), F.lit("_v"), (F.col("doc_id") % 3).cast("string")),
                        F.col("doc_id")))
    d = d.select("doc_id", F.concat(F.lit("data/"), name).alias("path"), name.alias("name"))
    return d.select("doc_id", "name", names.dataset_name("path").alias("dataset"))
