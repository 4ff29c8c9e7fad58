"""Connected components by alternating large and small stars; no link or component is collected to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.shared import materialize


def _state(e: DataFrame) -> tuple:
    """Edges, a sum of their hashes, and nodes that have a parent: by these the edges of two rounds are compared."""
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first())


def _settled(e: DataFrame, state: tuple) -> bool:
    """Whether each node has one parent, and no parent has one: then the parents are the components."""
    return state[0] == state[2] and e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (u long, v long) -> (node, component): the smallest node reachable, for each node that has a link.

    Each round halves the depth at least; minima are pre-aggregated before the shuffle, and the joins that carry a hub's
    neighbours read two plain shuffles, so that Spark can split a hub's rows.
    """
    e = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    before = _state(e)
    for _ in range(rounds if before[0] else 0):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-large")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "cc-step")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "cc-small")
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = materialize(small.where("u <> v").distinct(), "cc")
        now = _state(e)
        if now == before or _settled(e, now):
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
