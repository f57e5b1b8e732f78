"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermatch.sources.rounds import RunFolder


def components(edges: DataFrame, folder: RunFolder) -> DataFrame:
    """``node`` and ``root``, the component's smallest node, for all nodes of ``edges`` (``a``, ``b``,
    any order, repeats and loops allowed; nodes that only have loops are left out).

    Alternating large-star and small-star steps until every node points to its root. Each step takes
    minima by partial aggregation, writes them and joins them back, so that a node with very many
    neighbours is a plain skewed join, which Spark splits, and never one group.
    """
    pairs = edges.where("a <> b").select(
        F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")
    )
    stars = folder.scratch(pairs.distinct())
    before = None
    while (now := _signature(stars)) != before:
        before = now
        stars = _small_star(_large_star(stars, folder), folder)
    return stars.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def _signature(stars: DataFrame) -> tuple:
    return tuple(stars.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def _large_star(stars: DataFrame, folder: RunFolder) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node of its neighbourhood."""
    both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(stars.select("lo", "hi"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.where("v > u").join(folder.scratch(least), "u")
    return folder.scratch(joined.select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())


def _small_star(stars: DataFrame, folder: RunFolder) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = folder.scratch(stars.groupBy("hi").agg(F.min("lo").alias("m")))
    joined = stars.join(least, "hi")
    moved = joined.where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return folder.scratch(moved.union(least.select("hi", F.col("m").alias("lo"))).distinct())
