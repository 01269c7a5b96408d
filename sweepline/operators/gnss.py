"""Fixes from sentences, and their use beside local tracks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweepline.functions import nmea
from sweepline.operators.ordered import sections
from sweepline.operators.prefix import with_previous, with_running
from sweepline.session import checkpointed

KNOT = 0.514444444
VERTICAL = 1.6  # sigma of heights over that of places, where no sentence says it


def epochs(sentences: DataFrame, by: Sequence[str], order: Sequence[str], bucket: Column) -> DataFrame:
    """One fix for each burst of sentences that share a second of the day. sentences: nmea.decoded() rows.

    A burst ends where a sentence has another second (by more than half a millisecond); GSA and VTG have none and belong
    to the open burst. The last sentence of a kind counts. Places come from GGA, then from a valid RMC; the rest fills in.
    Bursts without GGA and RMC give no fix. Times are null until a session's first date.
    """
    second = F.coalesce("gga.sod", "rmc.sod", "gst.sod")
    at = with_previous(sentences.withColumn("_sod", second), by, order, {"_before": "_sod"}, bucket, nulls=False, keep=True)
    cut = sections(at, by, order, F.abs(F.col("_sod") - F.col("_before")) > 5e-4, bucket).withColumnRenamed("section", "epoch")
    kinds = [k.lower() for k in nmea.DECODERS]
    place = F.struct(*order)
    last = [F.max_by(k, F.when(F.col(k).isNotNull(), place)).alias(k) for k in kinds]
    bursts = cut.groupBy(*by, "epoch").agg(F.min(place).alias("opened"), F.min("_sod").alias("sod"), F.count("*").alias("sentences"), *last)
    bursts = bursts.where("gga is not null or rmc is not null")
    from_rmc = F.col("gga.lat").isNull() & F.col("rmc.lat").isNotNull() & F.col("rmc.valid")
    fix = F.when(F.col("gga.lat").isNotNull(), F.col("gga.fix")).when(from_rmc, F.col("rmc.fix")).otherwise("none")
    rows = bursts.withColumns({
        "fix": fix,
        "lat": F.coalesce("gga.lat", F.when(from_rmc, F.col("rmc.lat"))),
        "lon": F.coalesce("gga.lon", F.when(from_rmc, F.col("rmc.lon"))),
        "height": F.when(F.col("gga.lat").isNotNull(), F.coalesce("gga.alt", F.lit(0.0)) + F.coalesce("gga.geoid", F.lit(0.0))).otherwise(0.0),
        "hdop": F.coalesce("gga.hdop", "gsa.hdop"), "pdop": F.col("gsa.pdop"), "dimension": F.col("gsa.dimension"),
        "speed": F.coalesce("rmc.knots", "vtg.knots") * KNOT, "course": F.coalesce("rmc.course", "vtg.course"), "date": F.col("rmc.date"),
    })
    all_sigmas = F.col("gst.lat_sigma").isNotNull() & F.col("gst.lon_sigma").isNotNull() & F.col("gst.alt_sigma").isNotNull()
    ellipse = F.col("gst.major").isNotNull() & F.col("gst.minor").isNotNull()
    spread = F.when(F.col("hdop") > 0, F.greatest(F.lit(0.5), F.least(F.lit(5.0), "hdop"))).otherwise(1.0)
    plain = nmea.sigma_of(F.col("fix")) * spread
    of = lambda gst, factor=1.0: F.when(all_sigmas, gst).when(ellipse, F.col("gst.major") * factor).otherwise(plain * factor)
    rows = rows.withColumns({
        "sigma_north": of(F.col("gst.lat_sigma")), "sigma_east": of(F.col("gst.lon_sigma")), "sigma_up": of(F.col("gst.alt_sigma"), VERTICAL),
        "sigma_from_gst": F.coalesce(all_sigmas | ellipse, F.lit(False)),
    }).drop(*kinds)
    rows = checkpointed(rows)  # one row for each burst; what follows reads them again and again
    # a date holds until the next one; each time the second falls back by half a day without a date of its own, a day has passed
    few, turn = F.expr("epoch div 1000"), ["epoch"]
    held = with_previous(rows, by, turn, {"_sod": "sod"}, few, nulls=False, keep=True)
    passed = F.col("date").isNull() & (F.col("sod") + 43200 < F.col("_sod"))
    held = with_running(held, by, turn, {"_days": F.coalesce(passed.cast("long"), F.lit(0))}, few, keep=True)
    held = held.withColumn("_stamp", F.when(F.col("date").isNotNull(), F.struct("date", "_days")))
    held = with_previous(held, by, turn, {"_held": "_stamp"}, few, nulls=False).withColumn("_held", F.coalesce("_stamp", "_held"))
    day = F.date_add("_held.date", (F.col("_days") - F.col("_held._days")).cast("int"))
    return held.withColumn("utc_ns", nmea.unix_nanos(day, F.col("sod"))).drop("date", "_sod", "_days", "_stamp", "_held")


def thinned(rows: DataFrame, by: Sequence[str], t: str, least: int, schema: str) -> DataFrame:
    """Rows that lie at least ``least`` after the last kept one of their session, the first always; greedy, in order of t.

    Greedy choices depend on all before them, so a session is one task, fed in sorted Arrow batches.
    """
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[tuple, int] = {}
        for b in batches:
            times = b[t].to_numpy()
            keep = np.zeros(len(b), dtype=bool)
            starts = [0, *(np.flatnonzero((b[list(by)].shift() != b[list(by)]).any(axis=1).to_numpy())).tolist(), len(b)]
            for lo, hi in zip(starts, starts[1:], strict=False):
                if lo == hi:
                    continue
                key = tuple(b[c].iloc[lo] for c in by)
                at = lo
                if key in last:
                    at = lo + int(np.searchsorted(times[lo:hi], last[key] + least))
                while at < hi:  # one step for each kept row
                    keep[at] = True
                    last = {key: int(times[at])}
                    at = lo + int(np.searchsorted(times[lo:hi], times[at] + least))
            yield b.loc[keep, columns]

    return rows.select(*columns).repartition(*by).sortWithinPartitions(*by, t).mapInPandas(run, schema)


def similar(fit: tuple, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """A local point under a similarity (cos and sin of its yaw, scale, shift) in the plane; heights are scaled and shifted."""
    c, s, k, e, n, u = fit
    return e + k * (c * x - s * y), n + k * (s * x + c * y), u + k * z
