"""As-of interpolating joins of probes with a trajectory.

A busy session would be one window partition. So both sides are cut into time buckets, and each bucket gets
the last knot before it and the first one after it; windows then hold one bucket of one session each. Only
the list of buckets, one row each, is ordered by session.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sweepline.operators.prefix import with_running


def in_arrival_order(knots: DataFrame, by: str, arrival: str, t: str, bucket: Column) -> DataFrame:
    """knots with ``accepted``: whether t is later than that of every knot that arrived before. bucket is one of arrival."""
    at = with_running(knots, [by], [arrival], {}, bucket, {"_newest": F.col(t)})
    return at.withColumn("accepted", F.coalesce(F.col(t) > F.col("_newest"), F.lit(True)) & F.col(t).isNotNull()).drop("_newest")


def brackets(probes: DataFrame, knots: DataFrame, by: str, knot_columns: Sequence[str], bucket: int) -> DataFrame:
    """probes (by, t, ...) with ``before`` and ``after``: structs (t, knot columns) of the knots around each probe.

    before is the last knot with t_knot <= t; after the first with t_knot > t, or the knot itself where t hits it.
    Both are null where there is none.
    """
    knot = F.struct("t", *knot_columns)
    k = knots.where(F.col("t").isNotNull()).select(by, "t", knot.alias("knot"))
    own = [c for c in probes.columns if c not in (by, "t")]
    p = probes.select(by, "t", F.struct(*own).alias("own") if own else F.lit(None).alias("own"))
    slot = F.floor(F.col("t") / bucket).cast("long")
    ends = k.withColumn("b", slot).groupBy(by, "b").agg(F.min("knot").alias("first"), F.max("knot").alias("last"))
    wanted = p.where("t is not null").select(by, slot.alias("b")).distinct().join(ends, [by, "b"], "full")
    over = Window.partitionBy(by).orderBy("b")
    carried = wanted.select(
        by,
        "b",
        F.last("last", True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("in"),
        F.first("first", True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("out"),
    )
    carried = carried.select(by, "b", F.explode(F.array_compact(F.array("in", "out"))).alias("knot"))
    none = F.lit(None)
    rows = (
        k.select(by, slot.alias("b"), "t", F.lit(0).alias("side"), "knot", none.alias("own"))
        .unionByName(carried.select(by, "b", F.col("knot.t").alias("t"), F.lit(0).alias("side"), "knot", none.alias("own")))
        .unionByName(p.select(by, slot.alias("b"), "t", F.lit(1).alias("side"), none.alias("knot"), "own"))
    )
    parts = Window.partitionBy(by, "b")
    forward = parts.orderBy("t", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    backward = parts.orderBy(F.desc("t"), F.desc("side")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumns({"before": F.last("knot", True).over(forward), "after": F.last("knot", True).over(backward)})
    hit = F.col("before.t") == F.col("t")
    return found.where("side = 1").select(
        by, "t", *[F.col(f"own.{c}").alias(c) for c in own], "before", F.when(hit, F.col("before")).otherwise(F.col("after")).alias("after")
    )


def interpolated(column: str) -> Column:
    """The value of a knot column at t, on the line between the bracket's ends."""
    a, b = F.col(f"before.{column}"), F.col(f"after.{column}")
    return F.when(F.col("before.t") == F.col("after.t"), a).otherwise(a + (b - a) * fraction())


def fraction() -> Column:
    span = F.col("after.t") - F.col("before.t")
    return F.when(span > 0, (F.col("t") - F.col("before.t")) / F.when(span > 0, span)).otherwise(0.0)


def gate(max_gap: int, least_confidence: float | None = None, invalid: Column | None = None, lost: Column | None = None) -> Column:
    """The state of a bracket, the worst first."""
    both = F.col("before").isNotNull() & F.col("after").isNotNull()
    state = F.when(F.col("before").isNull() & F.col("after").isNull(), "no_data").when(F.col("before").isNull(), "before_first").when(~both, "future")
    if invalid is not None:
        state = state.when(invalid, "low_confidence")
    if lost is not None:
        state = state.when(lost, "tracking_lost")
    state = state.when(F.col("after.t") - F.col("before.t") > max_gap, "gap")
    if least_confidence is not None:
        state = state.when(F.least("before.confidence", "after.confidence") < least_confidence, "low_confidence")
    return state.otherwise("ok")
