"""Connected components of a large edge table by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrace.storage import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Every greater neighbour of a node points to the least of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its lesser neighbours point to the least of those."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, first: str, second: str) -> DataFrame:
    """(node, label) of every linked node but those that are the label of their component.

    The label is the least node of the component. Each round is written to the shared folder;
    rounds end when all components are stars. Their number is logarithmic in the longest path.
    """
    a, b = F.col(first), F.col(second)
    edges = links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = materialise(edges, "edges")
    while True:
        edges = materialise(_small_star(_large_star(edges)), "edges")
        # Done when every node has one edge, to a node that has none.
        twice = edges.groupBy("u").count().where("count > 1").select("u")
        inner = edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi")
        if twice.union(inner).isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
