"""Merging overlapping sessions into one map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweepline.operators.spatial import CELL, voxel_downsample, with_cells


def merge_build(points: DataFrame, sessions: DataFrame, voxel: float, claim: float) -> DataFrame:
    """The merged cloud, each point with its session.

    points: (session, x, y, z). sessions: (session, priority, converged, dx, dy, dz), few rows; sessions that
    aren't listed are skipped. Points are moved to the world frame and averaged by voxel in their session; then
    the first session, by (converged, priority, session), owns each claim voxel of the single-precision means.
    """
    placed = points.join(F.broadcast(sessions), "session")
    world = placed.select("session", "priority", "converged", *[(F.col(a) + F.col(f"d{a}")).alias(a) for a in ("x", "y", "z")])
    means = voxel_downsample(world, voxel, by=("session", "priority", "converged"))
    single = means.select("session", "priority", "converged", *[F.col(c).alias(f"v{c}") for c in CELL], *[F.col(a).cast("float").cast("double").alias(a) for a in ("x", "y", "z")])
    order = F.struct((~F.col("converged")).alias("late"), "priority", "session", "vi", "vj", "vk", "x", "y", "z")
    claimed = with_cells(single, claim).groupBy(*CELL).agg(F.min(order).alias("o"), F.count("*").alias("claims"))
    return claimed.select(*CELL, "o.session", "o.x", "o.y", "o.z", "claims")
