"""Connected components by alternating star contraction, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardwarden.session import materialize


def _undirected(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); the component is its least node.

    Each round points every neighbour above a node at that node's least neighbour, then every
    node's smaller neighbours at the least of them. Both keep the components; the number of
    rounds grows with the logarithm of the longest path. Every round is a written table, so a
    lost executor costs one round at most. Self links and repeated links do no harm.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = materialize(now, "links")
    for _ in range(max_rounds):
        both = _undirected(now)
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("m", "a").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.where("a <> b").distinct(), "links")
        if not _joints(large):
            now = large
            break
        small_least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        joined = large.join(small_least, F.col("a") == F.col("n"))
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small_least.select(F.col("n").alias("a"), F.col("m").alias("b")))
        now = materialize(small.where("a <> b").distinct(), "links")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    alone = edges.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots).union(alone)
    return found.groupBy("node").agg(F.min("component").alias("component"))


def _joints(links: DataFrame) -> bool:
    """Whether some node is above one and below another, or above two: then it is no star forest."""
    ends = links.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(links.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    seen = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return bool(seen.where("up > 1 or (up > 0 and down > 0)").limit(1).count())
