"""Connected components of a distributed edge table.

Alternates large-star and small-star steps (every node hands its larger,
then its smaller neighbours to its smallest neighbour) until the edges are
stars around the smallest node of each component: a number of rounds
logarithmic in the longest path. Each round is written to the shared folder,
so a lost executor repeats one round only. No step gathers a node's
neighbours in one row; a hub is one grouped minimum and a join that AQE can
split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    side = both if large else both.filter("v < u")
    low = side.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = side.join(low, "u")
    if large:
        out = moved.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``edges(u, v)`` (bigint): label is
    the smallest node reachable. Null ends and loops are ignored."""
    spark = edges.sparkSession
    # a pair is stored once, larger node first
    cur = materialize(spark, edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        state = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        step = materialize(spark, _star(cur, True), "large-star")
        cur = materialize(spark, _star(step, False), "small-star")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        cur.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
