"""Connected components by alternating large-star and small-star steps.

Each step is an aggregation and a join of the edges, so that no node's
neighbours meet in one task's memory; the number of rounds grows with the
logarithm of the longest path.  Edges are written to the shared folder after
each round, which cuts lineage, and the round before is removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_to, discard, scratch


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """``edges`` (u, v) with u > v."""
    both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if small:
        out = joined.select(F.col("v").alias("a"), "m").unionByName(least.select(F.col("u").alias("a"), "m"))
    else:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), "m").unionByName(least.select(F.col("u").alias("a"), "m"))
    return out.where(F.col("a") != F.col("m")).select(F.col("a").alias("u"), F.col("m").alias("v")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``component`` (the smallest node reachable) for every node of a link."""
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    spark = links.sparkSession
    path = scratch(spark, "edges")
    edges = cut_to(edges, path)
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
        old, path = path, scratch(spark, "edges")
        edges = cut_to(_star(_star(edges, small=False), small=True), path)
        discard(spark, old)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
