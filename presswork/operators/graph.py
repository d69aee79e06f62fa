"""Connected components of links between longs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.core.storage import materialise, release


def _hung(edges: DataFrame, every: bool) -> DataFrame:
    """Every neighbour (or only the smaller ones and the node itself) of a node to the smallest of them."""
    if every:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    else:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = near.join(least, "u")
    out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if every else met.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least)
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each node's component; nodes without another are left out.

    Alternating star rounds, so their number grows with the logarithm of a component.
    """
    edges = materialise(links.select("a", "b").where("a <> b").distinct(), "links")
    seen = None
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0])
        if now == seen or not now[0]:
            break
        seen, old = now, edges
        edges = materialise(_hung(_hung(edges, True), False), "links")
        release(old)
    out = materialise(edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select("b", "b")).distinct(), "components")
    release(edges)
    return out
