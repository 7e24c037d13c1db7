"""Streams of edge lines, as far as parsing goes: communities are found on whole graphs, in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources import parse_edges


def edge_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of the text files that arrive in a folder."""
    return parse_edges(spark.readStream.format("text").load(folder))
