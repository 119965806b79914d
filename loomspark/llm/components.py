"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step joins the edges with the least neighbour of each node: sums that combine before their
shuffle, and joins the engine can split where a node is hot. No neighbourhood is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, release

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v: long) to one row (node, component) for each node above its component's least node.

    ``component`` is the least node reachable; nodes that are their own least node have no row.
    The steps a chain takes grow with the logarithm of its length; ``MAX_ROUNDS`` without an end raises.
    """
    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = durable(edges, "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state["n"] == 0 or (state["n"], state["h"]) == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = (state["n"], state["h"])
        old, edges = edges, durable(_small_star(_large_star(edges)), "edges")
        release(old)
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
