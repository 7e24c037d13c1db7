"""Whole runs: from edges to communities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..config import Config
from ..operators import density
from ..operators.layout import run_layout
from ..operators.store import cut


@dataclass
class Result:
    positions: DataFrame
    metrics: DataFrame
    snapshots: DataFrame
    eps: float | None
    clusters: DataFrame
    communities: DataFrame


def find_communities(points: DataFrame, config: Config = Config()) -> tuple[float | None, DataFrame]:
    """The radius (none without enough points) and the clusters of points (id, x0..)."""
    kdist = cut(density.k_distance(points, config.min_pts))
    curve = density.curve(kdist, config.prune)
    row = density.elbow_eps(curve, config.elbow).first()
    eps = row["eps"] if row else None
    return eps, density.cluster(points, eps, config.min_pts, config.mode, kdist)


def detect(edges: DataFrame, config: Config = Config()) -> Result:
    found = run_layout(edges, config)
    eps, clusters = find_communities(found.positions.drop("deg"), config)
    clusters = cut(clusters)
    return Result(found.positions, found.metrics, found.snapshots, eps, clusters, density.communities(clusters))


def detect_communities(edges: DataFrame, config: Config = Config()) -> DataFrame:
    """cluster_id, members."""
    return detect(edges, config).communities
