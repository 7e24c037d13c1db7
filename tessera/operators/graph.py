"""Edges to adjacency, vertices and degrees.

Edges are a bag: a repeated edge counts each time, and a loop adds 2 to its vertex's degree. An edge with a null end is none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def whole(edges: DataFrame) -> DataFrame:
    """The edges with two ends."""
    return edges.where("src is not null and dst is not null")


def vertex_count(edges: DataFrame) -> DataFrame:
    """n: the largest id and one, 0 without edges."""
    return whole(edges).agg(F.coalesce(F.max(F.greatest("src", "dst")) + 1, F.lit(0)).cast("long").alias("n"))


def symmetrise(edges: DataFrame) -> DataFrame:
    """id, nbr: each edge from either end."""
    edges = whole(edges)
    return edges.select(F.col("src").alias("id"), F.col("dst").alias("nbr")).unionAll(edges.select(F.col("dst").alias("id"), F.col("src").alias("nbr")))


def degrees(edges: DataFrame) -> DataFrame:
    """id, deg of the vertices with edges."""
    return symmetrise(edges).groupBy("id").agg(F.count("*").cast("double").alias("deg"))


def vertices(edges: DataFrame) -> DataFrame:
    """id, deg of all vertices from 0 to the largest id; those between without edges have degree 0."""
    n = vertex_count(edges).first()["n"]
    return edges.sparkSession.range(n).join(degrees(edges), "id", "left").fillna(0.0, ["deg"])


def total_degree(edges: DataFrame) -> DataFrame:
    """total: twice the number of edges."""
    return whole(edges).agg((2.0 * F.count("*")).alias("total"))


def repulsion_factor(edges: DataFrame, attraction: float = 0.05, repulsion: float = 0.0) -> DataFrame:
    """total, factor: total^-1 * total^((a - r) / 2), 0 without edges."""
    return total_degree(edges).withColumn("factor", F.when(F.col("total") > 0, F.pow("total", F.lit(0.5 * (attraction - repulsion) - 1))).otherwise(F.lit(0.0)))
