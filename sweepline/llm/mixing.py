"""Mixing sources to target weights by Pfair scheduling (DataFrame operations only).

Each source's documents form blocks. A frame is one round in which every source is due as many blocks as its
share (an integer weight), or what is left of it. In a frame of L slots with k blocks of a source, block i
(from 1) is released at slot floor((i - 1) * L / k) and due at slot ceil(i * L / k). Earliest deadline first
among the released blocks then gives every block a slot in its window (the fractional schedule shows that
one exists), so at any slot a source's count of blocks differs from its target by less than one. Frames
that have the same block counts share one schedule. There are at most two such kinds of frame for each
source, so schedules are few however many rows there are.

Positions in a source come from counts of salted parts, never from one window over a source: a source may
hold a third of all rows. A part that many rows of one doc_id make large is cut again. All rows are kept; a source that
ends leaves its slots to the others. A frame's schedule costs its slots times its sources: this is meant for tens to
hundreds of sources, not for a source a web domain.

Defined results: a null source is a source of its own, named ``(null)``; an unlisted source has the default
share; shares are positive whole numbers, others are refused; rows that repeat a doc_id or have a null one are rows of
their own; texts and other columns play no part. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sweepline.llm.common import result, scratch, written


@dataclass(frozen=True)
class Parameters:
    #: documents in a block
    block: int = 16
    #: target weights: blocks of a source in each frame
    shares: Mapping[str, int] = field(default_factory=lambda: {"src0": 6, "src1": 3, "src2": 2})
    default_share: int = 1

    def __post_init__(self) -> None:
        for n in (self.block, self.default_share, *self.shares.values()):
            if not isinstance(n, int) or n < 1:
                raise ValueError(f"blocks and shares are positive whole numbers, not {n!r}")

    def share_of(self, source: Column) -> Column:
        share = F.lit(self.default_share)
        for name, s in sorted(self.shares.items()):
            share = F.when(source == name, s).otherwise(share)
        return share


NULL_SOURCE = "(null)"


def ranked(docs: DataFrame, p: Parameters) -> DataFrame:
    """doc_id, source and rank (from 0) in the source, in an order that hashes of doc_id fix."""
    named = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit(NULL_SOURCE)).alias("source"))
    # numbers tell repeated rows apart; they are written, so they stay as they are
    rows, _ = written(named.withColumn("row", F.monotonically_increasing_id()), "mix-rows")
    order = F.when(F.col("doc_id").isNull(), F.xxhash64("row")).otherwise(F.xxhash64("doc_id"))
    parts = F.ceil(F.sqrt("n"))  # so neither a part nor the list of parts is large
    sizes = rows.groupBy("source").agg(F.count("*").alias("n"))
    # the order's range is cut into as many equal parts as the source's size asks for
    part = F.floor((order.cast("double") / 2.0**64 + 0.5) * parts)
    cut = rows.join(sizes, "source").select("doc_id", "source", "row", part.alias("part"), parts.alias("parts"), order.alias("h"))
    # rows of one doc_id share a part, so a large part is cut by row number
    large = cut.groupBy("source", "part").agg(F.ceil(F.count("*") / (4 * F.max("parts"))).alias("cuts"))
    cut = cut.join(large, ["source", "part"]).withColumn("sub", F.pmod(F.xxhash64("row"), F.col("cuts"))).drop("cuts", "parts")
    counts = cut.groupBy("source", "part", "sub").agg(F.count("*").alias("rows"))
    before = counts.select(
        "source",
        "part",
        "sub",
        (F.sum("rows").over(Window.partitionBy("source").orderBy("part", "sub")) - F.col("rows")).alias("before"),
    )
    inside = F.row_number().over(Window.partitionBy("source", "part", "sub").orderBy("h", "doc_id", "row")) - 1
    found = cut.withColumn("inside", inside).join(before, ["source", "part", "sub"])
    return found.select("doc_id", "source", (F.col("before") + F.col("inside")).alias("rank"))


def frame_kinds(sizes: DataFrame, p: Parameters) -> DataFrame:
    """first, frames, slots, due, before: runs of frames that hold the same numbers of blocks of each source.

    sizes: (source, blocks). due: array<struct<source, k>>. Windows and joins here hold a few rows for each source.
    """
    sized = sizes.withColumn("share", p.share_of(F.col("source"))).withColumn("last", F.ceil(F.expr("blocks / share")))
    ends = sized.select(F.explode(F.array(F.lit(0).cast("long"), F.floor(F.expr("blocks / share")), F.col("last"))).alias("first")).distinct()
    # the last of these ends the last frame
    in_order = Window.orderBy("first")  # at most three rows for each source
    runs = ends.select("first", (F.lead("first").over(in_order) - F.col("first")).alias("frames"), (F.row_number().over(in_order) - 1).cast("long").alias("kind"))
    # a source is due in all runs before its last frame's end
    upto = sized.join(runs.select(F.col("first").alias("last"), F.col("kind").alias("kinds")), "last")
    active = upto.withColumn("kind", F.explode(F.sequence(F.lit(0).cast("long"), F.col("kinds") - 1)))
    k = F.least(F.col("share"), F.col("blocks") - F.col("first") * F.col("share"))
    return (
        active.join(runs.where("frames > 0"), "kind")
        .select("first", "frames", "source", k.cast("long").alias("k"))
        .groupBy("first", "frames")
        .agg(F.sort_array(F.collect_list(F.struct("source", "k"))).alias("due"), F.sum("k").alias("slots"))
        .withColumn("before", F.sum(F.expr("frames * slots")).over(Window.orderBy("first")) - F.expr("frames * slots"))
    )


def earliest_deadline_first(due: Column, slots: Column) -> Column:
    """array<struct<source, i>>: the block that each slot of a frame runs."""
    entry = T.StructType().add("source", "string").add("k", "long").add("i", "long")
    state = T.StructType().add("left", T.ArrayType(entry)).add(
        "done", T.ArrayType(T.StructType().add("source", "string").add("i", "long"))
    )
    start = F.struct(
        F.transform(due, lambda d: F.struct(d["source"].alias("source"), d["k"].alias("k"), F.lit(1).cast("long").alias("i"))).alias("left"),
        F.array().alias("done"),
    ).cast(state)

    def step(s: Column, t: Column) -> Column:
        released = F.filter(
            s["left"], lambda x: (x["i"] <= x["k"]) & (F.floor((x["i"] - 1) * slots / x["k"]) <= t)
        )
        chosen = F.array_min(
            F.transform(
                released,
                lambda x: F.struct(F.ceil(x["i"] * slots / x["k"]).alias("d"), x["source"].alias("source"), x["i"].alias("i")),
            )
        )
        ran = F.struct(chosen["source"].alias("source"), chosen["i"].alias("i"))
        left = F.transform(
            s["left"],
            lambda x: F.struct(
                x["source"].alias("source"),
                x["k"].alias("k"),
                F.when(x["source"] == chosen["source"], x["i"] + 1).otherwise(x["i"]).alias("i"),
            ),
        )
        return F.struct(left.alias("left"), F.concat(s["done"], F.array(ran)).alias("done")).cast(state)

    return F.aggregate(F.sequence(F.lit(0).cast("long"), slots - 1), start, step)["done"]


def mix(docs: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """doc_id, source, block (from 0, in its source), slot (from 0) and place (from 0, in its block) of every row, as a written table.

    Reading by (slot, place) gives the mixture.
    """
    with scratch(docs.sparkSession):
        return result(slotted(docs, p), "mix-slots")


def slotted(docs: DataFrame, p: Parameters) -> DataFrame:
    """The rows of mix(); reads tables of its own."""
    placed = ranked(docs, p).select(
        "doc_id", "source", F.expr(f"rank div {p.block}").alias("block"), F.expr(f"rank % {p.block}").alias("place")
    )
    placed, _ = written(placed, "mix-blocks")
    sizes = placed.groupBy("source").agg((F.max("block") + 1).alias("blocks"))
    kinds, _ = written(frame_kinds(sizes, p), "mix-frames")
    ran = kinds.select(
        "first",
        "frames",
        "slots",
        "before",
        "due",
        F.posexplode(earliest_deadline_first(F.col("due"), F.col("slots"))).alias("at", "b"),
    )
    schedule = ran.select(
        F.col("b.source").alias("source"), (F.col("b.i") - 1).alias("nth"), "first", "frames", "slots", "before", "at"
    )
    # schedule rows: two kinds of frame a source at most, so the condition on frames leaves one row
    runs = schedule.groupBy("source", "nth").agg(F.collect_list(F.struct("first", "frames", "slots", "before", "at")).alias("runs"))
    runs, _ = written(runs, "mix-runs")
    share = p.share_of(F.col("source"))
    frame = placed.withColumn("share", share).withColumn("frame", F.expr("block div share")).withColumn("nth", F.expr("block % share"))
    joined = frame.join(runs, ["source", "nth"])
    run = F.filter("runs", lambda r: (r["first"] <= F.col("frame")) & (F.col("frame") < r["first"] + r["frames"]))[0]
    return joined.withColumn("run", run).select(
        "doc_id",
        "source",
        "block",
        F.expr("run.before + (frame - run.first) * run.slots + run.at").alias("slot"),
        "place",
    )
