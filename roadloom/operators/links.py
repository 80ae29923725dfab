"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.sources.scratch import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v), u > v. Links neighbours to the smallest neighbour, above u (large) or below it (small)."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return out.where(F.col("u") > F.col("v")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with a link; component is the smallest node that can be reached.

    Each step is a partial aggregation and a join, written to the shared folder; steps end when nothing changes, which is
    after about the logarithm of the longest way. Loops and repeated links are ignored; nodes without links do not appear.
    """
    edges = materialize(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    mark = None
    while True:
        before, edges = edges, materialize(_star(_star(edges, True), False))
        discard(before)
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if mark == (now.n, now.x):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
        mark = (now.n, now.x)
