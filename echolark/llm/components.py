"""Connected components of a distributed edge list, by alternating large-star and small-star steps.

Hubs are joined, not gathered: their edges are rows of one key, which Spark's skew join splits, and
minima are pre-aggregated before each shuffle. Each step is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolark.core import staged

MAX_STEPS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b) with a > b; every node's neighbours are sent to its smallest one."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = staged(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")))
    near = both.where(F.col("b") > F.col("a")) if large else both
    moved = near.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        moved = moved.union(least.select("a", F.col("m").alias("b")))
    return staged(moved.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of links (a, b): label is the smallest node of its component."""
    edges = staged(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(edges)
    for _ in range(MAX_STEPS):
        if not before[0]:
            break
        edges = _star(_star(edges, large=True), large=False)
        if (now := _state(edges)) == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_STEPS} steps")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(roots)
