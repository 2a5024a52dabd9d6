"""Connected components of a graph that is a table of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, with_total, written


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars whose centre is their least node: no node has two edges to smaller ones, or edges both ways."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down + up > 1 AND down > 0").agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame, most: int = 40) -> DataFrame:
    """(node, root) of every node that has an edge (a, b) to another; root is the least node of its component.

    Each round is written to shared storage, so a lost executor costs no earlier round. Rounds end when the edges are
    stars, so edges that come as stars take none. No node's neighbours are gathered: a round takes their least by
    aggregation, and a hub's edges stay where they are (see with_total).
    """
    ordered = lambda e: e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = lambda e: with_total(e, "a", F.min("b"), "m")
    edges = written(ordered(edges).distinct(), "edges")
    for _ in range(most):
        if _settled(edges):
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: greater neighbours go to the least of the neighbourhood, or to the node itself
        large = written(ordered(least(both).where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))), "edges")
        # small star: a node and its smaller neighbours go to the least of them
        small = least(large).select("a", "b", "m")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        done, edges = edges, written(ordered(small).distinct(), "edges")
        discard(done)
        discard(large)
    else:
        if not _settled(edges):
            raise RuntimeError("components did not settle")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
