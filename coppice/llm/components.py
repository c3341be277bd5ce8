"""Connected components by alternating large-star and small-star rounds (Kiveris and others, 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.llm.common import stage


def _settled(edges: DataFrame) -> bool:
    """Whether each node has one edge down and no node that an edge leads to has one: then all lead to the least of their component."""
    roles = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("b", F.lit(0), F.lit(1)))
    return roles.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 or (down = 1 and up = 1)").limit(1).count() == 0


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b): each node of an edge that is not the least of its component, with that least node.

    edges has long columns a > b. Everything stays in tables; the driver sees one yes or no a
    round. Minima are pre-aggregated, and each join meets a staged table of one row a node, so
    that AQE may split a node with very many edges. Rounds grow with the logarithm of the
    longest chain, and there are as many as it takes.
    """
    edges = stage(edges.distinct())
    while not _settled(edges):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = stage(large.distinct())
        low = stage(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = stage(small.distinct())
    return edges
