"""Structured Streaming twins of batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def voxel_counts(points: DataFrame, size: float) -> DataFrame:
    """Running voxel means: update mode, partial sums in Spark's own state."""
    cells = [F.floor(F.col(a) * (1.0 / size)).cast("long").alias(c) for a, c in (("x", "i"), ("y", "j"), ("z", "k"))]
    return points.groupBy(*cells).agg(F.count("*").alias("n"), *[F.avg(a).alias(a) for a in ("x", "y", "z")])


def tumbling(events: DataFrame, width: str, late: str, by: str) -> DataFrame:
    """Counts and means of event-time windows; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), by).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def sessions(events: DataFrame, gap: str, late: str, by: str) -> DataFrame:
    """Time-gap sessions."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), by).agg(F.count("*").alias("n"))


def accept_in_order(rows: DataFrame) -> DataFrame:
    """Rows (session, arrival, t) that are later than all rows of their session that arrived before them.

    The state of a session is its newest time. Rows of a micro-batch are taken in order of arrival.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("arrival")
        kept = []
        for r in rows.itertuples(index=False):
            if newest is None or r.t > newest:
                newest = r.t
                kept.append((key[0], r.arrival, r.t))
        if newest is not None:
            state.update((int(newest),))
        yield pd.DataFrame(kept, columns=["session", "arrival", "t"])

    return (
        rows.select("session", "arrival", "t")
        .groupBy("session")
        .applyInPandasWithState(run, "session string, arrival long, t long", "newest long", "append", GroupStateTimeout.NoTimeout)
    )
