"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is a grouped minimum (partial aggregation, so a hub costs one row per map task)
and a join that the adaptive planner can split; each round is cut with a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuelens.llm._shared import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a > b).  Large: larger neighbours of a node join its smallest one; small: the others do."""
    near = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = near.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("m", "a").alias("m"))
    met = near.join(least, F.col("a") == F.col("u"))
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x")).select(F.col("x.b").alias("a"), F.col("x.m").alias("b"))
    return out.where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for each node with an edge.  ``edges``: two long columns."""
    x, y = edges.columns
    now = cut(edges.where(f"{x} != {y}").select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct(), "edges")
    mark = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (seen["n"], seen["h"]) == mark or not seen["n"]:
            break
        mark = (seen["n"], seen["h"])
        now = cut(_star(_star(now, True), False), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
