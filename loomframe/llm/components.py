"""Connected components of a graph held as a table of edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) with the least of u and all its neighbours. The minimum is combined before the shuffle, and the
    join back is one that Spark can split where a node has very many edges."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return edges.join(least, edges["u"] == least["k"]).select("u", "v", "m")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link; the component is its least node. ``links``: (a, b), any order.

    Both steps keep what is connected and move edges to the least node known; when nothing changes, every node has one
    edge, to the least node of its component. The number of rounds grows with the logarithm of the components' size.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    # the sums tell whether the set of edges is as it was
    state = lambda e: tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first())
    before = state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least_neighbour(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct(), "edges")
        small = _least_neighbour(large)
        moved = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        new = written(moved.where("u <> v").distinct(), "edges")
        drop_written(edges)
        drop_written(large)
        edges = new
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
