"""Connected components of a graph given as edges, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywatch.llm.common import materialize


def _least(edges: DataFrame) -> DataFrame:
    """``(u, least)``: the smallest of each node and its neighbours; partly combined before the shuffle."""
    return edges.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node with an edge to another; ``root`` is the smallest node of its component.

    Loops, repeated edges and nulls are ignored. Each round is written to the shared folder; only a count and a
    checksum reach the driver. A node with very many edges takes part in joins by its key, which adaptive execution
    splits, and in sums, which combine first. Rounds grow with the logarithm of the longest chain.
    """
    links = edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).filter("v < u").distinct()
    links = materialize(links, "components")
    before = None
    while True:
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: every greater neighbour of a node moves to the node's least neighbour.
        large = both.filter("v > u").join(_least(both), "u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        large = materialize(large, "components")
        # Small star: every smaller neighbour, and the node, move to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("least"))
        moved = large.join(low, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        links = materialize(moved.unionByName(low.select("u", F.col("least").alias("v"))).filter("v < u").distinct(), "components")
        state = links.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
        if state == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
