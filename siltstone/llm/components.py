"""Connected components of an edge table, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stage

MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node that is linked to it, itself included) for every node of edges (a, b), both long.

    Each round links a node's larger neighbours to its smallest one (large star), then its smaller neighbours (small star);
    rounds grow with the logarithm of the longest path. Minima are partial sums; the joins that carry them back have two
    shuffled sides, so that Spark splits the edges of a hub. Edges never leave the executors."""
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(MOST_ROUNDS):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = stage(both.where("b > a").join(nearest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        least = stage(large.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("x")), "least")
        down = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = stage(least.select("a", F.col("m").alias("b")).unionByName(down).distinct(), "edges")
        # done when every node has one neighbour, and no neighbour has a smaller one itself
        open_ends = not least.where("m <> x").isEmpty() or not after.join(after.select(F.col("b").alias("a")), "a", "left_semi").isEmpty()
        discard(now, nearest, large, least)
        now = after
        if not open_ends:
            break
    else:
        raise RuntimeError(f"not done after {MOST_ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
