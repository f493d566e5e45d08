"""Connected components of an edge table, by alternating star contraction in Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, materialize


def large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every node's larger neighbours move to the smallest node around it. A node with many neighbours is a hot key of the join."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
    joined = join_counted(both.where(F.col("b") > F.col("a")), least, ["a"], 2 * total)
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def small_star(edges: DataFrame, total: int) -> DataFrame:
    """Every node and its smaller neighbours move to the smallest of them. Edges point from larger to smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    joined = join_counted(edges, least, ["a"], total)
    moved = joined.where(F.col("b") > F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge, root itself included; root is the component's smallest node.

    edges: columns a and b (long), any direction; loops and repeats do no harm. Rounds grow as the logarithm of the number
    of nodes. Every round is written to the checkpoint folder, for the next starts from it.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    edges = materialize(edges)
    before = state(edges)
    while before[0]:
        edges = materialize(small_star(large_star(edges, before[0]), before[0]))
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
