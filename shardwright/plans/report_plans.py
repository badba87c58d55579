"""Report queries: token budget, call accuracy, benchmark average, plateau."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import packing, reports
from ..operators.ordering import with_adaptive_bucket
from .registry import query
from .tables import table


@query("token_budget", sql="""
SELECT lang, source, sum(strlen(text) + 1)::BIGINT AS tokens, GROUPING(lang, source) AS level
FROM documents GROUP BY ROLLUP (lang, source)""")
def q_token_budget(spark, sf_dir):
    d = packing.tokenize(table(spark, sf_dir, "documents").select("lang", "source", "text"), "text")
    return reports.token_budget(d.withColumnRenamed("n_tokens", "tokens"), ["lang", "source"]) \
        .select("lang", "source", "tokens", "level")


def calls(spark, sf_dir):
    """Truth and prediction call tables derived from ``labels``: call 0
    ``rate(quality, toxic)``, call 1 ``flag(toxic)``; the prediction names
    another function when doc_id % 11 = 0, flips quality when % 5 = 0,
    flips the flag when % 7 = 0 and leaves out call 1 when % 13 = 0."""
    lab = table(spark, sf_dir, "labels")
    q, t, d = F.col("quality").cast("string"), F.col("toxic").cast("string"), F.col("doc_id")
    truth = lab.select(d.alias("sample_id"), F.explode(F.array(
        F.struct(F.lit(0).alias("call_no"), F.lit("rate").alias("function"),
                 F.create_map(F.lit("quality"), q, F.lit("toxic"), t).alias("params")),
        F.struct(F.lit(1).alias("call_no"), F.lit("flag").alias("function"),
                 F.create_map(F.lit("toxic"), t).alias("params")))).alias("c")).select("sample_id", "c.*")
    pq = F.when(d % 5 == 0, (1 - F.col("quality")).cast("string")).otherwise(q)
    pt = F.when(d % 7 == 0, (1 - F.col("toxic")).cast("string")).otherwise(t)
    c0 = F.struct(F.lit(0).alias("call_no"),
                  F.when(d % 11 == 0, F.lit("score")).otherwise(F.lit("rate")).alias("function"),
                  F.create_map(F.lit("quality"), pq, F.lit("toxic"), t).alias("params"))
    c1 = F.struct(F.lit(1).alias("call_no"), F.lit("flag").alias("function"),
                  F.create_map(F.lit("toxic"), pt).alias("params"))
    pred = lab.select(d.alias("sample_id"), F.explode(
        F.when(d % 13 == 0, F.array(c0)).otherwise(F.array(c0, c1))).alias("c")).select("sample_id", "c.*")
    return truth, pred


@query("call_accuracy", sql="""
SELECT count(*) AS n_samples,
       avg(CASE WHEN doc_id % 11 <> 0 AND doc_id % 5 <> 0 AND doc_id % 13 <> 0 AND doc_id % 7 <> 0
                THEN 1.0 ELSE 0.0 END)::DOUBLE AS accuracy
FROM labels""")
def q_call_accuracy(spark, sf_dir):
    return reports.call_accuracy(*calls(spark, sf_dir))


@query("call_soft_accuracy", sql="""
WITH c AS (
  SELECT CASE WHEN doc_id % 11 = 0 THEN 0.0
              ELSE ((CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 1 END) + 1)::DOUBLE / 2 END AS s FROM labels
  UNION ALL
  SELECT CASE WHEN doc_id % 13 = 0 OR doc_id % 7 = 0 THEN 0.0 ELSE 1.0 END FROM labels)
SELECT count(*) AS n_calls, avg(s)::DOUBLE AS soft_accuracy FROM c""")
def q_call_soft_accuracy(spark, sf_dir):
    return reports.call_soft_accuracy(*calls(spark, sf_dir))


@query("score_average", sql="""
WITH s AS (
  SELECT 'm' || (doc_id % 3) AS model, 'quality' AS task, 100 * avg(quality) AS score FROM labels GROUP BY 1
  UNION ALL
  SELECT 'm' || (doc_id % 3), 'toxic', 100 * avg(toxic) FROM labels GROUP BY 1)
SELECT model, count(DISTINCT task) AS n_tasks, round(avg(score), 9) AS average FROM s GROUP BY model""")
def q_score_average(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").withColumn("model", F.concat(F.lit("m"), (F.col("doc_id") % 3).cast("string")))
    long = lab.unpivot(["model"], ["quality", "toxic"], "task", "value")
    scores = long.groupBy("model", "task").agg((F.avg("value") * 100).alias("score"))
    return reports.score_average(scores, ["model"]).withColumn("average", F.round("average", 9))


PLATEAU_LIMIT = 3
PLATEAU_ROWS = 1 << 15   # evaluations of a run per bucket


ORACLE_PLATEAU = f"""
WITH s AS (SELECT user_id, event_id, ts, value,
                  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step,
                  min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM events),
i AS (SELECT *, value < least(coalesce(prior, 1000.0::DOUBLE), 1000.0::DOUBLE) AS improved,
             least(coalesce(prior, 1000.0::DOUBLE), 1000.0::DOUBLE, value) AS best FROM s),
l AS (SELECT *, max(CASE WHEN improved THEN step ELSE -1 END)
                  OVER (PARTITION BY user_id ORDER BY ts, event_id
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last FROM i)
SELECT user_id AS run, event_id, step, best, improved, (step - last)::INTEGER AS bad,
       step - last >= {PLATEAU_LIMIT} AS alert
FROM l"""


@query("plateau_alert", sql=ORACLE_PLATEAU)
def q_plateau_alert(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), "event_id", "ts", "value")
    # seconds without a time zone; a run is cut by its own span and number of rows
    second = F.unix_date(F.to_date("ts")).cast("bigint") * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60 + F.floor(F.second("ts"))
    ev = with_adaptive_bucket(ev.withColumn("second", second), "second", ["run"], PLATEAU_ROWS)
    p = reports.plateau(ev, "run", ["ts", "event_id"], "value", PLATEAU_LIMIT, bucket=F.col("__abucket"))
    return p.select("run", "event_id", "step", "best", "improved", "bad", "alert")
