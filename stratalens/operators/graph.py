"""Connected components of an undirected graph, for duplicate clusters and classes of equivalent columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.staging import stage


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) for every node of the edges; a component is named by its smallest node.

    Alternates the "large star" and "small star" steps: every node is linked to the smallest node it knows of, first
    from its larger neighbours, then from its smaller ones. Long chains halve in each round, so the rounds grow with
    the logarithm of the longest path. Each step takes a minimum per node (combined before the shuffle) and joins it
    back on the node, where one side has a single row per node; adaptive execution splits a node with very many edges.
    """
    pairs = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    links = stage(
        pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _stars(links):
        links = stage(_small_star(_large_star(links)), "edges")
    # now every node points at the smallest node of its component
    named = links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _stars(links: DataFrame) -> bool:
    """Whether every node either points at one smaller node or is pointed at: then it points at the smallest of its component."""
    ends = links.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")),
                                          F.struct(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where('"out" > 1 OR ("out" > 0 AND "in" > 0)'.replace('"', "`")).isEmpty()


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node among the node and its neighbours."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    moved = both.where("v > u").join(least, "u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, is linked to the smallest of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
