"""Connected components by alternating large-star and small-star steps, over edges that never leave the cluster."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """edges: (u, v) with u > v. One step; each node's least neighbour comes from a partial aggregate and a join, so that
    a node with very many neighbours is spread over tasks."""
    if small:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.union(least.select("u", F.col("m").alias("v"))).distinct()
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def star_components(edges: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, label) of each node of edges (a, b), label being the least node of its component. The steps are about the square of the logarithm
    of the longest chain; they end when nothing changes. cut(df) writes a table and reads it back."""
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        now = cut(_stars(_stars(now, False), True))
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            roots = now.select(F.col("v").alias("node")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots.select("node", F.col("node").alias("label")))
        seen = mark
