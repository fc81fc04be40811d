"""Connected components by alternating large and small stars, and set links verified exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, written


def components(edges: DataFrame) -> DataFrame:
    """node, label (smallest node of its component) for every node of ``edges`` (a, b: long, neither null), as a written table.

    Large-star and small-star steps are joins and minimum aggregates, so a node with many neighbours spreads over
    tasks; rounds grow with the logarithm of the longest path. Each round is a written table."""
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        # Large star: every larger neighbour of a node moves to the least of the node and its neighbours.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a node and its smaller neighbours move to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = written(small, "edges")
        marks = [t.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for t in (now, new)]
        removed(now)
        now = new
        if marks[0] == marks[1]:
            break
    out = written(now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()), "components")
    removed(now)
    return out
