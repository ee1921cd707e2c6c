"""Connected components of an edge table, by joins and written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from slopeweave.session import cut, cut_counting


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``edges (a, b)``; the root is the least node of its component.

    Rounds of the large-star and small-star steps: each node's larger neighbours, then its smaller ones, are
    linked to the least of them, until every edge goes to a root. A node's least neighbour is found by an aggregation
    and joined back, so that no neighbourhood is held in one task; Spark splits skewed keys of such joins.
    """
    edges = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both).filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = cut(large.distinct(), "edges")
        small = _star(large)
        links = small.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(small.select("a", F.col("least").alias("b")))
        joined, seen = cut_counting(links.filter("a <> b").distinct(), "edges", n=F.count(F.lit(1)), a=F.sum(F.xxhash64("a", "b") % (1 << 31)))
        before = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 31))).first()
        edges = joined
        if tuple(before) == (seen["n"], seen["a"]):
            nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _star(edges: DataFrame) -> DataFrame:
    """Edges with the least of node ``a`` and its neighbours ``b``."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a").select("a", "b", F.least("a", "m").alias("least"))
