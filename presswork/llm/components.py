"""Connected components by large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.llm.common import join_aggregate, materialise, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the smallest one; minima by an aggregate and a join that can be split, so a hub is no single row or task."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = join_aggregate(both, low, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): its component's smallest node.

    Each round is written to the shared folder, and the round before is deleted; the
    rounds end when the edges repeat. The result is a written table.

    Defined cases: links of a node with itself and repeated links count for nothing, and a
    node with no other link is not in the result; links with a null end are left out; an
    empty table gives an empty result.
    """
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0])

    seen = mark(edges)
    while seen[0]:
        before, edges = edges, materialise(_star(_star(edges, True), False), "edges")
        release(before)
        now = mark(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("b").alias("a"), "b")
    out = materialise(edges.union(roots).distinct().select(F.col("a").alias("node"), F.col("b").alias("label")), "components")
    release(edges)
    return out
