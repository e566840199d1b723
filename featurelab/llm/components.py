"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelab.sources.work import materialize


def _low(edges: DataFrame) -> DataFrame:
    """Smallest neighbour of each ``a`` or itself. Written, so that the join with it can be split
    when one node holds a large part of all edges."""
    return materialize(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")), "low")


def _star_forest(edges: DataFrame) -> bool:
    """Whether every node hangs on one root and no root hangs on another node."""
    children = edges.groupBy("a").agg(F.count(F.lit(1)).alias("parents"))
    if children.where("parents > 1").limit(1).count():
        return False
    roots = edges.select(F.col("b").alias("a")).distinct()
    return roots.join(children.select("a"), "a", "left_semi").limit(1).count() == 0


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component, for every node that has an edge.

    ``edges`` has two columns of one orderable type, in any direction; repeated edges, loops and
    NULL ends change nothing. Each round is two joins on the smallest neighbour, and the number of
    rounds grows with the logarithm of the longest path. Nothing is collected; every round is a
    written table, so a lost executor repeats one round at most.
    """
    left, right = edges.columns
    pairs = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a is not null and b is not null")
    loops = pairs.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("root"))
    edges = materialize(
        pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    while not _star_forest(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = materialize(
            both.where("b > a").join(_low(both), "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct(),
            "large_star",
        )
        low = _low(large)
        small = large.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = materialize(small.unionByName(low.select("a", F.col("low").alias("b"))).distinct(), "small_star")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    known = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
    return materialize(known.unionByName(loops.join(known, "node", "left_anti").distinct()), "components")
