"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm._common import cut, split_join, stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round on edges (a, b) with a > b.

    Large: every node hands its larger neighbours to its smallest one.  Small:
    every node hands its smaller neighbours and itself to the smallest one.
    The smallest neighbour comes from an aggregate and goes back by a join that
    leaves the edges of a hub where they are, so a node with very many
    neighbours is neither collected nor dealt to one task.
    """
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("_rows")), "stars")
        made = split_join(both.where("b > a"), least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = stored(edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_rows")), "stars")
        moved = split_join(edges, least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        made = moved.union(least.select("a", F.col("m").alias("b")))
    return made.where("a > b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b), any two comparable
    ids: component is the smallest node reachable.  Loops and repeats are
    harmless; no edge gives no row.  Rounds grow with the logarithm of the
    longest chain; each ends in a checkpoint.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    while True:
        after = cut(_stars(cut(_stars(now, True)), False))
        same = after.count() == now.count() and after.join(now, ["a", "b"], "left_anti").isEmpty()
        now = after
        if same:
            break
    # now every edge goes from a node to its component
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
