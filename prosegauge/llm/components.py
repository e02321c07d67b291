"""Connected components of a large edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, sweep


def connected_components(edges: DataFrame) -> DataFrame:
    """Label every node that has an edge with the smallest node it can reach.

    edges: columns u, v (long); direction, repeats and loops don't matter; nulls are ignored.
    Returns node, root. Each round makes every node point at the smallest neighbour of its
    neighbours (large star, then small star), so the rounds grow with the logarithm of a
    component's size. Nothing but one checksum a round reaches the driver. Empty in, empty out.
    """
    at = cut(
        edges.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).where("a is not null and b is not null and u is not null and v is not null and a != b").distinct()
    )
    before = None
    while True:
        both = at.union(at.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").union(low.select("a", F.col("m").alias("b"))).distinct()
        at = cut(small)
        now = at.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
        sweep(edges.sparkSession)
    roots = at.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(at.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
