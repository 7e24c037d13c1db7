"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut, drop


def components(edges: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) of every id in edges (a, b) with two different ends.

    Null ends and loops are dropped; no edges give no rows. Minima are summed up before they are joined, so a hub's edges needn't meet in one task. Each
    round's edges are stored, and those of the round before deleted.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        star = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = star.groupBy("a").agg(F.min("b").alias("m"))
        small = star.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        before, edges = edges, cut(small)
        drop(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    out = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return out.unionByName(out.select(F.col("component").alias("id"), "component").distinct())
