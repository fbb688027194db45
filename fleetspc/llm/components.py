"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspc.sources.workspace import drop, materialize


def _distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("hi") != F.col("lo")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every neighbour above a node with the least node around it."""
    ends = edges.select(F.col("hi").alias("node"), F.col("lo").alias("other")).unionByName(
        edges.select(F.col("lo").alias("node"), F.col("hi").alias("other"))
    )
    least = ends.groupBy("node").agg(F.min("other").alias("other"))
    least = least.select(F.col("node").alias("lo"), F.least("node", "other").alias("least"))
    return _distinct_edges(edges.join(least, "lo").select("hi", F.col("least").alias("lo")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every node and its lower neighbours with the least of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("least"))
    moved = edges.join(least, "hi").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
    return _distinct_edges(moved.unionByName(least.select("hi", F.col("least").alias("lo"))))


def _state(edges: DataFrame) -> tuple:
    digest = F.xxhash64("hi", "lo").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(digest)).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b) that is not the least of its component.

    Stars alternate until the edges no longer change, after about log(longest path) rounds, with
    the edges stored after each. Only their count and a checksum reach the driver. A node with a
    great many edges is aggregated before the shuffle, and its joins can be split.
    """
    edges = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    current = materialize(_distinct_edges(edges), "edges")
    before = _state(current)
    while before[0]:
        following = materialize(_small_star(_large_star(current)), "edges")
        after = _state(following)
        drop(current)
        current = following
        if after == before:
            break
        before = after
    return current.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
