"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every greater neighbour of a node on the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    hung = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.filter("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its lesser neighbours on the least of these. ``u > v`` in every edge."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node that links (a, b) lead to, for every node with a link.

    Each round is written to the shared folder; only a count and a checksum come to the driver. Nodes with any
    number of links are safe: minima are aggregated before the shuffle, and the joins can be split.
    """
    least, most = F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")
    edges = written(links.filter("a != b").select(most, least).distinct(), "edges")
    before = None
    while (now := _state(edges)) != before:
        before = now
        edges = written(_small_star(_large_star(edges)), "edges")
    # the edges are stars now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
