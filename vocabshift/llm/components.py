"""Connected components of a link table, by alternating star contractions in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocabshift.llm.common import discard, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or itself)."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.union(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (a, b); a component is named by its smallest node.

    Each round is written to the shared folder and replaces the one before; ``discard`` removes the last.  It ends when the links are stars around smallest nodes: no node has
    two smaller neighbours and no centre is itself a leaf.  Rounds grow with the logarithm of the longest path.
    """
    edges = stored(links.where("a <> b").select("a", "b").distinct(), "links")
    while True:
        before, edges = edges, stored(_small_star(_large_star(edges)).distinct(), "stars")
        discard(before)
        many = edges.groupBy("a").count().where("count > 1").select("a")
        chained = edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").select("a")
        if not many.union(chained).limit(1).count():
            break
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = leaves.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    found.stored_at = edges.stored_at
    return found
