"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.scratch import shared_dir


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    others = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` of comparable ids → ``(node, component)``, the smallest id that each node can reach.

    Nodes without edges don't appear; loops and repeated edges don't matter.  No row is ever gathered by component:
    each round is two aggregations with partial sums and two joins, and its edge table goes to the checkpoint folder, so
    a lost executor costs one round at most.  The number of rounds is logarithmic in the longest chain.
    """
    shared_dir(edges.sparkSession)
    edges = edges.select("u", "v").where("u <> v").distinct().checkpoint()
    before = None
    for _ in range(max_rounds):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64(F.greatest("u", "v"), F.least("u", "v")).cast("decimal(38,0)"))).first()
        if before == now:
            break
        before = now
        edges = _small_star(_large_star(edges)).checkpoint()
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
