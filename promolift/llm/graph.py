"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut


def _least_neighbour(both: DataFrame) -> DataFrame:
    """(u, m): the least node among u and its neighbours."""
    return both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns ``a``, ``b``, two ids
    that differ); root is the least node of its component.

    Each step replaces an edge by one to the least known neighbour, so edges
    never outnumber the start; the minimum is pre-aggregated before the shuffle
    and joined back, which Spark can split for a hub node. Edges are written to
    the checkpoint folder after every round. Stops when a round changes nothing
    (a logarithmic number of rounds in practice). An empty table gives no rows.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
              .where(F.col("u") != F.col("v")).distinct())
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
                        F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                now.select(F.col("v"), F.col("v")).distinct())
        seen = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (both.join(_least_neighbour(both), "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        large = cut(large.where("u != v"))
        least = _least_neighbour(large)
        now = cut(large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                  .union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct())
