"""Connected components of an edge table by alternating large-star and small-star passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v): point the neighbours of each node to its smallest neighbour.

    The smallest neighbour comes from an aggregate with partial sums and is joined back, so a hub isn't gathered in one task.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = both.join(least, "u")
    if large:
        out = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node points to one other node, and that one to none."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("out")).union(edges.select("v", F.lit(0)))
    return ends.groupBy("n").agg(F.sum("out").alias("out"), F.min("out").alias("least")).where("out > 1 OR (out = 1 AND least = 0)").isEmpty()


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """edges (a, b), any order, repeats and loops allowed, no nulls -> (node, comp), comp the smallest node reachable.

    Nodes without an edge to another node don't occur. The number of rounds grows as the logarithm of the number of nodes;
    each round is written to the shared folder. Passes keep what is connected, so when stars alone are left they are the components.
    """
    now = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") != F.col("v")).distinct(), "edges")
    for _ in range(most_rounds):
        if _is_stars(now):
            break
        now = staged(_star(_star(now, True), False), "stars")
    else:
        raise RuntimeError("components did not settle")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return leaves.union(leaves.select(F.col("comp").alias("node"), "comp").distinct())


def grown(comps: DataFrame, edges: DataFrame) -> DataFrame:
    """components() of what comps (node, comp) connects already and of edges (a, b) besides: stars settle sooner than their links."""
    return components(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(edges.select("a", "b")))
