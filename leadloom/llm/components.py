"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import saved


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """One half-step: every node hands its least neighbour to its larger neighbours, or (small) to its smaller ones and itself."""
    both = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = saved(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
    told = both.join(least, "a")
    if small:
        told = told.select(F.col("b").alias("v"), "m").unionByName(least.select(F.col("a").alias("v"), "m"))
    else:
        told = told.filter("b > a").select(F.col("b").alias("v"), "m")
    return told.filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for all nodes of links (a, b): large and small stars in turn until nothing moves.

    Edges point from the larger node to the smaller one and never grow in number; rounds grow with the logarithm of the
    longest path. Each half-round is a table in the shared folder. What nodes hand out is a table too, so that the edges of
    a node with very many neighbours can be split.
    """
    edges = saved(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())
    before = mark(edges)
    while before[0]:
        edges = saved(_stars(saved(_stars(edges, False), "star"), True), "stars")
        now = mark(edges)
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
