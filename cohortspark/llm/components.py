"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, saved


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Every node points its larger neighbours to its smallest neighbour (itself included)."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("w"))
    return join_hot(both.where("v > u"), least, "u", "w", n).select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Every node points its smaller neighbours and itself to the smallest of them; edges run from larger (a) to smaller (b)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("w"))
    moved = join_hot(edges, least, "a", "w", n).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node with an edge in `edges`(a, b): the smallest node it is connected to.

    Each round is two grouped minima with their joins, in which hubs are not dealt to one task; rounds grow with the
    logarithm of the longest path and go on until the edges stay as they are. Edges are written to the
    checkpoint folder every round, so a lost executor costs one round at most."""
    now = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    digest, seen = None, (now.count(), None)
    while seen != digest:
        digest, n = seen, seen[0]
        now = saved(_small_star(saved(_large_star(now, n)), n))
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select("b", "b")).distinct()
