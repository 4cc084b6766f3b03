"""Connected components of a graph given as an edge table, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlake.session import cut


def _hang(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Hang neighbours of every node below the smallest node it knows.

    ``larger_only``: of all neighbours those above the node (large star); otherwise the
    node itself and its neighbours below it (small star).
    """
    if larger_only:
        both = edges.select("a", "b").unionByName(
            edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
        )
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
        hung = both.join(least, "a").filter(F.col("b") > F.col("a"))
        return hung.select(F.col("b").alias("a"), F.col("root").alias("b")).distinct()
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("root"))
    own = least.select("a", F.col("root").alias("b"))
    others = down.join(least, "a").filter(F.col("b") != F.col("root"))
    return own.unionByName(
        others.select(F.col("b").alias("a"), F.col("root").alias("b"))
    ).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge (a, b).

    Rounds grow with the logarithm of the longest path; each is written out. Ids are long.
    """
    edges = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        edges = cut(_hang(_hang(edges, True), False))
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == seen:
            break
        seen = now
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return leaves.unionByName(roots)
