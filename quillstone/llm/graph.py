"""Connected components of a graph that is kept as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import _shared


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the smallest node that each node of an edge can reach.

    Alternates large-star and small-star steps until nothing changes, about
    log(n) rounds. Every round pre-aggregates before it shuffles, settles its
    edges in the shared folder and joins settled tables, so that adaptive
    execution can split the edges of a hot node.
    """
    edges = _shared.settle(_undirected(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))), "edges")
    while True:
        large = _star(_both_ways(edges), larger=True)
        small = _shared.settle(_star(large, larger=False), "star")
        # Both are distinct: they are equal if as many are in either as in both.
        sizes = {edges.count(), small.count()}
        done = len(sizes) == 1 and edges.join(small, ["u", "v"]).count() in sizes
        _shared.discard(edges)
        edges = small
        if done:
            break
    # All edges now point from a node (u) to its component's smallest node (v).
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _undirected(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger to its smaller end."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Connect the larger (else smaller) neighbours of each node, and itself, to the smallest of them."""
    least = _shared.settle(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
    edges = _shared.settle(edges, "ends")
    joined = edges.join(least, "u")
    if larger:
        linked = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = joined.where("v < u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.where("u > m").select("u", F.col("m").alias("v")))
    return _undirected(linked)
