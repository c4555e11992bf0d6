"""Connected components of an edge table, by alternating large and small stars.

Every round is a written table, so lineage stays short and lost executors cost one round.
Each node ends linked to the smallest node of its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molscreen.session import materialise


def _summary(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("u", "v"), 20))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node goes to the node's smallest neighbour (or the node)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("least")).select("n", F.least("least", "n").alias("least"))
    moved = both.where("v > u").join(least, F.col("u") == F.col("n"))
    return moved.where("v <> least").select(F.col("least").alias("u"), "v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, go to the smallest of them."""
    least = edges.groupBy(F.col("v").alias("n")).agg(F.min("u").alias("least"))
    moved = edges.join(least, F.col("v") == F.col("n")).where("u <> least").select(F.col("least").alias("u"), F.col("u").alias("v"))
    return moved.unionByName(least.select(F.col("least").alias("u"), F.col("n").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v) but the roots; self-links are ignored."""
    pairs = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    now = materialise(pairs, "edges")
    before = None
    while (state := _summary(now)) != before:
        before = state
        now = materialise(_small_star(_large_star(now)), "stars")
    return now.select(F.col("v").alias("node"), F.col("u").alias("root"))
