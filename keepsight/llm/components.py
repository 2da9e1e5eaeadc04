"""Connected components of a graph of links, by rounds of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsight.llm.storage import Scratch, drop


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Connect neighbours to the least vertex around: the larger ones, or the smaller ones."""
    if large:
        near = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:  # every edge is seen from its larger end
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = near.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
    joined = near.join(low, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b")))
    return out.filter("a <> b").distinct()


def _unsettled(edges: DataFrame) -> DataFrame:
    """Vertices that have two edges up, or an edge to one that has an edge up itself."""
    ends = edges.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select(F.col("b"), F.lit(0), F.lit(1)).distinct()
    )
    sums = ends.groupBy("a").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return sums.filter("up > 1 OR (up > 0 AND down > 0)")


def components(links: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """``id, comp`` of every vertex of ``links`` (``a, b``); ``comp`` is its component's least id.

    Each round's edges are written, so a lost executor costs one round at most; rounds go
    up with the logarithm of the longest chain, and end when every component is one star.
    """
    spark = links.sparkSession
    edges, path = scratch.located(links.filter("a <> b").select("a", "b").distinct(), "edges")
    for _ in range(rounds):
        star, star_path = scratch.located(_star(_star(edges, True), False), "edges")
        drop(spark, path)
        edges, path = star, star_path
        if _unsettled(edges).isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    found = edges.select(F.col("a").alias("id"), F.col("b").alias("comp"))
    return found.union(found.select(F.col("comp").alias("id"), "comp").distinct())


def contracted(links: DataFrame) -> DataFrame:
    """Links ``a, b`` that join the same vertices as ``links``, most of them straight to a least one.

    One round of ``components``: links that make stars are settled by it, longer chains are not.
    """
    return _star(_star(links.filter("a <> b").select("a", "b").distinct(), True), False)
