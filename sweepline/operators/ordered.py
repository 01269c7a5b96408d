"""Operators on ordered rows: sessions, runs, intervals, clocks, counters, loops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sweepline.operators.prefix import with_previous, with_running


def sections(rows: DataFrame, by: Sequence[str], order: Sequence[str], breaks: Column, bucket: Column) -> DataFrame:
    """rows with ``section``: how many breaks there were up to each row. breaks is a column of the row, such as one of with_previous()."""
    flagged = rows.withColumn("_break", F.coalesce(breaks, F.lit(False)).cast("long"))
    return with_running(flagged, by, order, {"section": F.col("_break")}, bucket).drop("_break")


def path_length(rows: DataFrame, by: Sequence[str], order: Sequence[str], axes: Sequence[str], bucket: Column) -> DataFrame:
    """rows with ``path`` (length so far) and ``loop_fraction`` (its share of the whole)."""
    at = with_previous(rows, by, order, {f"_{a}": a for a in axes}, bucket, keep=True)
    square = sum(((F.col(a) - F.col(f"_{a}")) * (F.col(a) - F.col(f"_{a}")) for a in axes), F.lit(0.0))
    path = with_running(at, by, order, {"path": F.sqrt(square)}, bucket).drop(*[f"_{a}" for a in axes])
    whole = path.groupBy(*by).agg(F.max("path").alias("_whole"))  # one row a session
    at = path.join(whole, list(by))
    return at.withColumn("loop_fraction", F.when(F.col("_whole") > 0, F.col("path") / F.nullif("_whole", F.lit(0.0))).otherwise(0.0)).drop("_whole")


def merged_intervals(rows: DataFrame, by: Sequence[str], join_gap: float, bucket: Column) -> DataFrame:
    """Unions of (lo, hi) intervals that overlap or lie within join_gap of each other."""
    at = with_running(rows.where("lo <= hi"), by, ["lo", "hi"], {}, bucket, {"_reach": F.col("hi")}, keep=True)
    return sections(at, by, ["lo", "hi"], F.col("lo") > F.col("_reach") + join_gap, bucket).groupBy(*by, "section").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n"))


def runs(rows: DataFrame, by: Sequence[str], t: str, gap: float, pad: float, least: float, bucket: Column) -> DataFrame:
    """Runs of sorted values split at gaps, padded, the short ones dropped."""
    at = with_previous(rows, by, [t], {"_t": t}, bucket, keep=True)
    found = sections(at, by, [t], F.col(t) - F.col("_t") > gap, bucket).groupBy(*by, "section").agg((F.min(t) - pad).alias("lo"), (F.max(t) + pad).alias("hi"), F.count("*").alias("n"))
    return found.where(F.col("hi") - F.col("lo") >= least)


def interval_overlap(a: DataFrame, b: DataFrame, by: Sequence[str], bucket: Column) -> DataFrame:
    """The total length that two interval lists cover both, each of disjoint intervals; by a sweep over their ends.

    bucket is one of ``at``, the place of an end.
    """
    ends = lambda d, c: d.where("lo < hi").select(*by, F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias(c)), F.struct(F.col("hi").alias("at"), F.lit(-1).alias(c)))).alias("e")).select(*by, "e.*")
    both = ends(a, "_a").unionByName(ends(b, "_b2"), True).fillna(0, ["_a", "_b2"]).groupBy(*by, "at").agg(F.sum("_a").alias("_a"), F.sum("_b2").alias("_b2"))
    open_ = with_running(both, by, ["at"], {"_in_a": F.col("_a"), "_in_b": F.col("_b2")}, bucket, keep=True)
    # a stretch begins at the end before it: that one's state holds up to here
    swept = with_previous(open_, by, ["at"], {"_from": "at", "_pa": "_in_a", "_pb": "_in_b"}, bucket)
    return swept.where("_pa > 0 and _pb > 0").groupBy(*by).agg(F.sum(F.col("at") - F.col("_from")).alias("overlap"))


def min_delay_envelope(pairs: DataFrame, by: str, window: int, clamp: float) -> DataFrame:
    """Each session's clock offset and drift from the least delay of each tumbling window of device time.

    pairs: (by, device, arrival). Windows are aligned to the first device time, not anchored to the pair that
    opens each: a set-based variant of the sequential rule.
    """
    start = pairs.groupBy(by).agg(F.min("device").alias("_start"))  # one row a session
    at = pairs.join(start, by).withColumn("w", F.floor((F.col("device") - F.col("_start")) / window)).withColumn("delta", F.col("arrival") - F.col("device"))
    least = at.groupBy(by, "w").agg(F.min(F.struct("delta", "device")).alias("m")).select(by, F.col("m.device").alias("x"), F.col("m.delta").alias("y"))
    slopes = least.groupBy(by).agg(F.regr_slope("y", "x").alias("raw"), F.count("*").alias("windows"))
    slopes = slopes.withColumn("slope", F.coalesce(F.greatest(F.lit(-clamp), F.least(F.lit(clamp), "raw")), F.lit(0.0)))
    return least.join(slopes, by).groupBy(by, "slope", "windows").agg(F.min(F.col("y") - F.col("slope") * F.col("x")).alias("intercept"))


def nearest_rank(values: Column, p: float) -> Column:
    """The nearest-rank quantile of a sorted array."""
    return F.element_at(values, F.greatest(F.lit(1), F.ceil(p * F.size(values)).cast("int")))


def jitter(rows: DataFrame, by: str, order: Sequence[str], value: str, last: int = 512) -> DataFrame:
    """rows with ``jitter``: p95 - p5 of the last so many values."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(-(last - 1), 0)
    ring = F.array_sort(F.collect_list(value).over(w))
    return rows.withColumn("_ring", ring).withColumn("jitter", nearest_rank(F.col("_ring"), 0.95) - nearest_rank(F.col("_ring"), 0.05)).drop("_ring")


def sync_tier(jitter_ms: Column) -> Column:
    return F.when(jitter_ms <= 5, "good").when(jitter_ms <= 15, "fair").otherwise("poor")


def loss_tracker(rows: DataFrame, by: str, order: Sequence[str], counter: str, bucket: Column, bits: int = 16, reset: int = 1024) -> DataFrame:
    """Counts by session: in sequence, duplicate, lost numbers, resets; and the share of numbers lost."""
    at = with_previous(rows, [by], order, {"_before": counter}, bucket)
    g = at.select(by, F.pmod(F.col(counter) - F.col("_before"), F.lit(1 << bits)).alias("gap"))
    lost = F.sum(F.when((F.col("gap") > 1) & (F.col("gap") < reset), F.col("gap") - 1).otherwise(0))
    out = g.groupBy(by).agg(
        F.count("*").alias("packets"),
        F.count_if(F.col("gap") == 1).alias("in_sequence"),
        F.count_if(F.col("gap") == 0).alias("duplicates"),
        F.count_if(F.col("gap") >= reset).alias("resets"),
        lost.alias("lost"),
    )
    return out.withColumn("loss", F.col("lost") / (F.col("lost") + F.col("packets")).cast("double"))


def loop_candidates(knots: DataFrame, by: str, apart: float, least_path: float, most_gap: float, least_excursion: float) -> DataFrame:
    """Each session's best loop: the pair of knots that come near again after a walk.

    knots: (by, n, t, x, path), thinned. Best: longest path, then smallest gap, then first pair.
    """
    a = knots.select(by, F.col("n").alias("a"), F.col("t").alias("ta"), F.col("x").alias("xa"), F.col("path").alias("pa"))
    b = knots.select(by, F.col("n").alias("b"), F.col("t").alias("tb"), F.col("x").alias("xb"), F.col("path").alias("pb"))
    pairs = a.join(b, by).where("b > a").withColumn("gap", F.abs(F.col("xb") - F.col("xa")))
    excursion = F.max("gap").over(Window.partitionBy(by, "a").orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
    found = pairs.withColumn("excursion", excursion).withColumn("length", F.col("pb") - F.col("pa"))
    good = found.where((F.col("tb") - F.col("ta") >= apart) & (F.col("length") >= least_path) & (F.col("gap") <= most_gap) & (F.col("excursion") >= least_excursion))
    best = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("length"), "gap", "a", "b"))
    return good.withColumn("_r", best).where("_r = 1").select(by, "a", "b", "length", "gap", "excursion")


def scan_assembly(rows: DataFrame, by: str, t: str, order: Sequence[str], width: int, target: int) -> DataFrame:
    """Tumbling scans, thinned by a stride that the previous scan's count sets."""
    at = rows.withColumn("scan", F.floor(F.col(t) / width).cast("long"))
    sizes = at.groupBy(by, "scan").agg(F.count("*").alias("points"))
    before = F.lag("points").over(Window.partitionBy(by).orderBy("scan"))
    strides = sizes.select(by, "scan", "points", F.greatest(F.lit(1), F.ceil(F.coalesce(before, F.lit(0)) / float(target))).cast("long").alias("stride"))
    nth = F.row_number().over(Window.partitionBy(by, "scan").orderBy(t, *order)) - 1
    kept = at.withColumn("nth", nth).join(strides, [by, "scan"]).where("nth % stride = 0")
    return kept.groupBy(by, "scan", "points", "stride").agg(F.count("*").alias("kept"))


def cross_correlation(a: DataFrame, b: DataFrame, most: int) -> DataFrame:
    """lag and normalised correlation of two tracks (i, v) on one grid, means removed, for each lag."""
    centred = lambda d: d.join(F.broadcast(d.agg(F.avg("v").alias("m"))), F.lit(True)).select("i", (F.col("v") - F.col("m")).alias("v"))
    lags = F.explode(F.sequence(F.lit(-most).cast("long"), F.lit(most).cast("long"))).alias("lag")
    left = centred(a).select("i", F.col("v").alias("va"), lags).withColumn("i", F.col("i") + F.col("lag"))
    joined = left.join(centred(b).withColumnRenamed("v", "vb"), "i")
    sums = joined.groupBy("lag").agg(F.sum(F.col("va") * F.col("vb")).alias("ab"), F.sum(F.col("va") * F.col("va")).alias("aa"), F.sum(F.col("vb") * F.col("vb")).alias("bb"), F.count("*").alias("n"))
    norm = F.sqrt(F.col("aa") * F.col("bb"))
    return sums.select("lag", "n", F.when(norm > 0, F.col("ab") / F.when(norm > 0, norm)).otherwise(0.0).alias("ncc"))
