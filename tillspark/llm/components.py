"""Connected components of a link table by alternating star contraction, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillspark.session import materialise


def _contract(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: link the neighbours of every node (the larger ones, or the rest with the node) to its smallest one."""
    if large:
        near = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = near.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
    linked = near.join(low, near["a"] == low["node"])
    if large:
        out = linked.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select(F.col("node").alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for the nodes of the links (a, b) that aren't the smallest themselves.

    Large and small stars alternate until nothing changes (Kiveris and others, 2014): few rounds even for long chains. Each
    round is written to the shared folder. Nodes are 64-bit numbers.
    """
    edges = materialise(edges.select("a", "b").where(F.col("a") != F.col("b")).distinct())
    sign = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")))
    state = None
    while True:
        edges = materialise(_contract(_contract(edges, large=True), large=False))
        now = edges.select(sign.alias("s")).first()["s"]
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state = now
