"""Reports: token budgets, function-call accuracy, benchmark averages and
the evaluation-loss plateau alert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import ordinal, running

# Fixed value: the best loss a run starts from.
PLATEAU_START_LOSS = 1000.0


def token_budget(df: DataFrame, levels: Sequence[str], tokens: str = "tokens") -> DataFrame:
    """A4: token totals by each prefix of ``levels`` plus the grand total
    (``rollup``; the grouping id tells subtotal rows apart)."""
    return df.rollup(*levels).agg(F.sum(tokens).cast("bigint").alias("tokens"),
                                  F.grouping_id().alias("level"))


def call_accuracy(truth: DataFrame, pred: DataFrame, sample: str = "sample_id", call: str = "call_no") -> DataFrame:
    """A5: share of samples whose calls all match (same function and the
    same parameters); a missing predicted call is a miss. Tables hold
    ``(sample, call, function, params map<string,string>)``."""
    t = truth.select(sample, call, F.col("function").alias("t_fn"), F.col("params").alias("t_params"))
    p = pred.select(sample, call, F.col("function").alias("p_fn"), F.col("params").alias("p_params"))
    same_params = F.coalesce(
        (F.size("t_params") == F.size("p_params")) &
        F.forall(F.map_entries("t_params"),
                 lambda e: F.try_element_at(F.col("p_params"), e["key"]).eqNullSafe(e["value"])),
        F.lit(False))
    ok = F.coalesce(F.col("t_fn") == F.col("p_fn"), F.lit(False)) & same_params
    per_call = t.join(p, on=[sample, call], how="left").select(sample, ok.alias("ok"))
    per_sample = per_call.groupBy(sample).agg(F.bool_and("ok").alias("ok"))
    return per_sample.agg(F.count("*").alias("n_samples"),
                          F.avg(F.col("ok").cast("double")).alias("accuracy"))


def call_soft_accuracy(truth: DataFrame, pred: DataFrame, sample: str = "sample_id",
                       call: str = "call_no") -> DataFrame:
    """Per truth call, the share of its parameters the prediction gets
    right (0 when the function differs or the call is missing); the mean
    over calls."""
    t = truth.select(sample, call, F.col("function").alias("t_fn"),
                     F.explode_outer("params").alias("key", "t_val"))
    p = pred.select(sample, call, F.col("function").alias("p_fn"), F.col("params").alias("p_params"))
    j = t.join(p, on=[sample, call], how="left")
    hit = (F.coalesce(F.col("t_fn") == F.col("p_fn"), F.lit(False)) &
           F.coalesce(F.try_element_at("p_params", F.col("key")) == F.col("t_val"), F.lit(False)))
    fn_ok = F.coalesce(F.col("t_fn") == F.col("p_fn"), F.lit(False))
    per_call = j.groupBy(sample, call).agg(
        F.sum(hit.cast("int")).alias("right"), F.count("key").alias("total"),
        F.bool_or(fn_ok).alias("fn_ok"))
    score = F.when(F.col("total") > 0, F.col("right") / F.col("total")) \
        .otherwise(F.col("fn_ok").cast("double"))
    return per_call.agg(F.count("*").alias("n_calls"), F.avg(score).alias("soft_accuracy"))


def score_average(scores: DataFrame, by: Sequence[str], task: str = "task", score: str = "score") -> DataFrame:
    """Unweighted mean of the task scores."""
    return scores.groupBy(*by).agg(F.count_distinct(task).alias("n_tasks"), F.avg(score).alias("average"))


def plateau(evals: DataFrame, run: str, order: Sequence[str], loss: str, limit: int,
            bucket: Column | None = None) -> DataFrame:
    """Per evaluation, ``best`` (lowest loss so far, starting at 1000.0),
    ``improved`` (strictly lower than every earlier loss and the start),
    ``bad`` (evaluations since the last improvement) and ``alert`` (bad
    reaches ``limit``; it only alerts). The running minimum of ``(loss,
    step)`` holds the best loss with the step that reached it first, which
    is the last improvement. Both running steps are split by ``bucket``
    (non-decreasing in ``order``) so a long run is not one task."""
    if bucket is not None:
        # one column, so that its inputs are worked out once for both steps
        evals = evals.withColumn("__evals", bucket)
        bucket = F.col("__evals")
        x = ordinal(evals, list(order), by=[run], bucket=bucket, out="step")
    else:
        x = running(evals.withColumn("__one", F.lit(1)), "__one", "sum", list(order), by=[run], out="step") \
            .withColumn("step", F.col("step") - 1).drop("__one")
    reached = F.when(F.col(loss).isNotNull(), F.struct(F.col(loss).alias("loss"), F.col("step").alias("step")))
    x = running(x, reached, "min", list(order), by=[run], bucket=bucket, out="__best")
    below = F.coalesce(F.col("__best.loss") < PLATEAU_START_LOSS, F.lit(False))
    x = x.withColumn("improved", F.when(F.col(loss).isNotNull(), below & (F.col("__best.step") == F.col("step")))) \
        .withColumn("best", F.least(F.lit(PLATEAU_START_LOSS), F.col("__best.loss"))) \
        .withColumn("bad", (F.col("step") - F.when(below, F.col("__best.step")).otherwise(F.lit(-1))).cast("int"))
    return x.withColumn("alert", F.col("bad") >= F.lit(limit)).drop("__best", "__evals")
