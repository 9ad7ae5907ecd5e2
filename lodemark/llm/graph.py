"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _is_stars(edges: DataFrame) -> bool:
    """Whether each node has one parent at most and no parent has one itself."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("child")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("child")))
    nodes = ends.groupBy("node").agg(F.sum("child").alias("n"), F.min("child").alias("lo"))
    return nodes.where("n > 1 or (n = 1 and lo = 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(a, b): each node a that is not the least of its component, with the least, b.

    ``edges`` has two columns of one orderable type. Each step is an aggregate and a join on
    a node, so a hub's edges are aggregated before the shuffle and its join can be split;
    the number of steps grows with the logarithm of the longest path, and edges that are
    stars already take none.
    """
    x, y = edges.columns
    edges = checkpointed(edges.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).where("a <> b").distinct())
    while not _is_stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = checkpointed(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
    return edges
