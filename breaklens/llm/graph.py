"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breaklens.session import pin


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (u, v), where label is the smallest node reachable.

    Each round points the larger neighbours of a node at its smallest one, then the smaller ones; the
    rounds grow with the logarithm of the longest path. A round is aggregates and joins of the edge
    table, written to the shared folder; no node's neighbours are gathered. Self loops and repeated
    edges do not matter; no edges give no rows.
    """
    now = pin(_ordered(edges.select("u", "v")), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = pin(_ordered(small.union(lower)), "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots)


def _ordered(edges: DataFrame) -> DataFrame:
    pair = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return pair.distinct()


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free checksum of the edges: equal marks mean that nothing moved."""
    digest = F.xxhash64("u", "v").cast("decimal(20,0)")
    return tuple(edges.agg(F.count("*"), F.sum(digest)).first())
