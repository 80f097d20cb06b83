"""Connected components of an edge table, by alternating large-star and small-star rounds.

A large-star round links every larger neighbour of a node to the smallest node around it, a
small-star round links the smaller neighbours. Both are one aggregation and one join, so a hot
node costs one partial row per task and a join key that adaptive skew handling can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickstack.session import checkpoint_root


def _star(pairs: DataFrame, with_self: bool) -> DataFrame:
    """``pairs(u, v)``: each v around u, and u itself, is linked to the smallest of them."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    around = pairs.unionByName(least.select("u", F.col("u").alias("v"))) if with_self else pairs
    out = around.join(least, "u")
    keep = F.col("v") != F.col("m") if with_self else F.col("v") > F.col("u")
    return out.where(keep).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``u, v`` edges to ``node, root``: the smallest node reachable, for every node that is not
    itself the root. Edges may repeat, point either way, or loop. Stops when a round changes nothing."""
    checkpoint_root(edges.sparkSession)
    current = edges.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint(eager=True)
    seen = None
    while True:
        mark = current.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen or not mark[0]:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = tuple(mark)
        # Small-star reads edges from the larger end, so its input is the large-star result as is.
        current = _star(_star(_both_ways(current), False), True).checkpoint(eager=True)
