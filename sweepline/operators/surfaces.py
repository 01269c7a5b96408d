"""Planes of cells and neighbourhoods, and how far a map agrees with itself.

Coordinates inside a cell are counted in whole units (2^-18 of the cell), so moments are sums of integers: they are exact, and the
same for any order and any partitions of the points. A sum holds over a hundred million points of one cell and window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sweepline.functions.geometry import let
from sweepline.operators import spatial
from sweepline.operators.spatial import CELL

UNIT = 1 << 18
AXES = ("x", "y", "z")
PAIRS = tuple((a, b) for i, a in enumerate(AXES) for b in AXES[i:])


# ---- 3 x 3 symmetric matrices ----------------------------------------------------------------------------------


def eigen(c: Callable[[str], Column]) -> Column:
    """A struct of the eigenvalues e1 <= e2 <= e3 of the matrix c("xx"), c("xy"), ... and the unit vector nx, ny, nz of e1.

    Closed form. The vector's largest component is positive; it is null where e1 and e2 are equal to a millionth (a line or a ball), since then no
    direction is the thin one.
    """

    def shifted(m: Column) -> Column:
        q = (m["xx"] + m["yy"] + m["zz"]) / 3
        return F.struct(*[m[a + b].alias(a + b) for a, b in PAIRS], q.alias("q"), (m["xx"] - q).alias("dx"), (m["yy"] - q).alias("dy"), (m["zz"] - q).alias("dz"))

    def spread(m: Column) -> Column:
        off = m["xy"] * m["xy"] + m["xz"] * m["xz"] + m["yz"] * m["yz"]
        p = F.sqrt((m["dx"] * m["dx"] + m["dy"] * m["dy"] + m["dz"] * m["dz"] + 2 * off) / 6)
        det = m["dx"] * (m["dy"] * m["dz"] - m["yz"] * m["yz"]) - m["xy"] * (m["xy"] * m["dz"] - m["yz"] * m["xz"]) + m["xz"] * (m["xy"] * m["yz"] - m["dy"] * m["xz"])
        return F.struct(m.alias("m"), p.alias("p"), det.alias("det"))

    def values(s: Column) -> Column:
        p, q = s["p"], s["m"]["q"]
        half = F.when(p > 0, s["det"] / (2 * p * p * p)).otherwise(0.0)
        third = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), half))) / 3
        return let(third, lambda a: F.struct(s["m"].alias("m"), p.alias("p"), (q + 2 * p * F.cos(a + 2.0943951023931953)).alias("e1"), (q + 2 * p * F.cos(a)).alias("e3")))

    def vector(s: Column) -> Column:
        m = s["m"]
        ax, ay, az = (m[k] - s["e1"] for k in ("xx", "yy", "zz"))
        one, two, three = (ax, m["xy"], m["xz"]), (m["xy"], ay, m["yz"]), (m["xz"], m["yz"], az)

        def crossed(a: tuple, b: tuple) -> Column:
            v = a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]
            return let(F.struct(*[x.alias(k) for x, k in zip(v, AXES, strict=True)]), lambda n: F.struct((n["x"] * n["x"] + n["y"] * n["y"] + n["z"] * n["z"]).alias("s"), n.alias("n")))

        return F.struct(s.alias("s"), F.greatest(crossed(one, two), crossed(one, three), crossed(two, three)).alias("v"))

    def named(t: Column) -> Column:
        s, n, size = t["s"], t["v"]["n"], t["v"]["s"]
        big = F.greatest(*[F.abs(n[k]) for k in AXES])
        sign = F.when(F.abs(n["z"]) == big, F.signum(n["z"])).when(F.abs(n["y"]) == big, F.signum(n["y"])).otherwise(F.signum(n["x"]))
        by = F.when(size > s["p"] * s["p"] * s["p"] * s["p"] * 1e-12, sign / F.sqrt(size))
        return F.struct(s["e1"].alias("e1"), (3 * s["m"]["q"] - s["e1"] - s["e3"]).alias("e2"), s["e3"].alias("e3"), *[(n[k] * by).alias(f"n{k}") for k in AXES])

    entries = F.struct(*[c(a + b).cast("double").alias(a + b) for a, b in PAIRS])
    return let(let(let(let(let(entries, shifted), spread), values), vector), named)


def with_eigen(rows: DataFrame, c: str = "c") -> DataFrame:
    """rows with eigen() of the columns cxx, cxy, cxz, cyy, cyz, czz."""
    return rows.select("*", eigen(lambda k: F.col(c + k)).alias("_e")).select(*rows.columns, "_e.*")


# ---- planes of groups ------------------------------------------------------------------------------------------


def with_offsets(points: DataFrame, size: float) -> DataFrame:
    """points with their cells and their places ux, uy, uz inside them (0 to 1); rows with a null or NaN coordinate go."""
    inside = {f"u{a}": F.col(a) * (1.0 / size) - F.col(c) for a, c in zip(AXES, CELL, strict=True)}
    return spatial.with_cells(points, size).withColumns(inside)


def moments(offsets: DataFrame, by: Sequence[str]) -> DataFrame:
    """n, and the sums of the whole units s<axis> and of their products s<axis><axis>, of each group."""
    unit = {a: F.floor(F.col(f"u{a}") * UNIT).cast("long") for a in AXES}
    sums = [F.sum(unit[a]).alias(f"s{a}") for a in AXES] + [F.sum(unit[a] * unit[b]).alias(f"s{a}{b}") for a, b in PAIRS]
    return offsets.groupBy(*by).agg(F.count("*").alias("n"), *sums)


def with_planes(m: DataFrame) -> DataFrame:
    """moments() with the mean m<axis> and the thin direction n<axis>, in units of the cell; see with_eigen()."""
    n, u = F.col("n").cast("double"), float(UNIT)
    means = {f"m{a}": F.col(f"s{a}") / n / u for a in AXES}
    products = {f"c{a}{b}": (F.col(f"s{a}{b}") - F.col(f"s{a}").cast("double") * F.col(f"s{b}") / n) / n / u / u for a, b in PAIRS}
    sums = [f"s{a}" for a in AXES] + [f"s{a}{b}" for a, b in PAIRS]
    return with_eigen(m.withColumns(means | products).drop(*sums)).drop(*products)


def normal_offset() -> Column:
    """How far ux, uy, uz lies from the plane of m and n along n, in units of the cell."""
    return F.abs((F.col("ux") - F.col("mx")) * F.col("nx") + (F.col("uy") - F.col("my")) * F.col("ny") + (F.col("uz") - F.col("mz")) * F.col("nz"))


def mean_offset() -> Column:
    """The mean of normal_offset(), summed as integers."""
    fine = float(1 << 30)
    return F.sum(F.floor(normal_offset() * fine).cast("long")) / fine / F.count("*")


# ---- exact ranks -----------------------------------------------------------------------------------------------


def picked(values: DataFrame, by: Sequence[str], value: str, shares: dict[str, float], width: float, nearest: bool = False) -> DataFrame:
    """By group, its number of values and for each share p the value at place floor(p n) of the sorted ones, from 0.

    With ``nearest`` the place is p (n - 1), rounded.

    Counts by value and by steps of ``width`` find the step of each place; only its values are sorted. No window holds more
    than one group's steps, or one step's different values.
    """
    step = F.floor(F.col(value) / width).cast("long")
    counts = values.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n")).withColumn("_s", step)
    steps = counts.groupBy(*by, "_s").agg(F.sum("_n").alias("_n"))
    group, along = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumns({"_all": F.sum("_n").over(group), "_before": F.coalesce(F.sum("_n").over(along), F.lit(0))})
    at = (lambda p: F.floor((F.col("_all") - 1) * p + 0.5)) if nearest else (lambda p: F.least(F.floor(F.col("_all") * p), F.col("_all") - 1))
    place = {k: at(p).cast("long") for k, p in shares.items()}
    asked = steps.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), c.alias("at")) for k, c in place.items()])).alias("_a"))
    asked = asked.where((F.col("_before") <= F.col("_a.at")) & (F.col("_a.at") < F.col("_before") + F.col("_n")))
    inside = counts.alias("l").join(asked.alias("r"), _same(by) & (F.col("l._s") == F.col("r._s")))
    inside = inside.select(*[F.col(f"l.{c}") for c in by], F.col(f"l.{value}").alias("_v"), F.col("l._n").alias("_n"), "_a", "_before", "_all")
    upto = Window.partitionBy(*by, "_a.k").orderBy("_v")
    hit = inside.withColumn("_upto", F.col("_before") + F.sum("_n").over(upto)).where(F.col("_upto") > F.col("_a.at"))
    return hit.groupBy(*by).agg(F.max("_all").alias("n"), *[F.min(F.when(F.col("_a.k") == k, F.col("_v"))).alias(k) for k in shares])


def _same(by: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in by:
        out = out & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return out


# ---- self-consistency ------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Consistency:
    #: Fixed values.
    cell: float = 0.25
    ratio: float = 0.09
    least: int = 8
    window: int = 8_000_000_000
    apart: int = 4


def offset_votes(points: DataFrame, by: Sequence[str], p: Consistency = Consistency()) -> DataFrame:
    """by, separation, offset: for each cell that two windows painted, the later one's mean distance from the earlier one's plane.

    points: by, t, x, y, z. Separation 0 is a window against itself: the plane of its first half (by x, y, z) and the points
    of its second. Cells with fewer than ``least`` points of a window (twice as many for 0) or without a clear plane don't vote.
    """
    key = [*by, *CELL, "w"]
    start = points.groupBy(*by).agg(F.min("t").alias("_t0"))
    at = points.alias("l").join(start.alias("r"), _same(by)).select("l.*", ((F.col("t") - F.col("_t0")) / p.window).alias("_w"))
    at = with_offsets(at.withColumn("w", F.floor("_w").cast("long")), p.cell).select(*key, "x", "y", "z", "ux", "uy", "uz")
    full = moments(at, key).where(F.col("n") >= p.least)
    clear = (F.col("e3") > 0) & (F.col("e1") <= p.ratio * F.col("e3")) & F.col("nx").isNotNull()
    plane = [f"{k}{a}" for k in "mn" for a in AXES]
    earlier = with_planes(full).where(clear).select(*key, *plane)
    later = earlier.withColumn("separation", F.explode(F.sequence(F.lit(1), F.lit(p.apart)))).withColumn("w", F.col("w") + F.col("separation"))
    asked = later.alias("l").join(full.select(*key).alias("r"), _same(key)).select("l.*")
    both = at.alias("l").join(asked.alias("r"), _same(key)).select("l.*", *[f"r.{c}" for c in (*plane, "separation")])
    votes = both.groupBy(*key, "separation").agg(mean_offset().alias("offset"))
    # a window against itself
    run = Window.partitionBy(*key)
    halves = at.withColumns({"_n": F.count("*").over(run), "_k": F.row_number().over(run.orderBy("x", "y", "z"))}).where(F.col("_n") >= 2 * p.least)
    first = F.col("_k") <= F.expr("_n div 2")
    half = with_planes(moments(halves.where(first), key)).where(clear).select(*key, *plane)
    second = halves.where(~first).alias("l").join(half.alias("r"), _same(key)).select("l.*", *[f"r.{c}" for c in plane])
    own = second.groupBy(*key).agg(mean_offset().alias("offset")).withColumn("separation", F.lit(0))
    return votes.select(*by, "separation", "offset").unionByName(own.select(*by, "separation", "offset"))


def self_consistency(points: DataFrame, by: Sequence[str], p: Consistency = Consistency()) -> DataFrame:
    """by, separation (in windows), cells, median and p90 offset, of every separation with votes; 0 is the floor."""
    found = picked(offset_votes(points, by, p), [*by, "separation"], "offset", {"median_offset": 0.5, "p90_offset": 0.9}, 1 / 4096)
    scaled = [(F.col(c) * p.cell).alias(c) for c in ("median_offset", "p90_offset")]
    return found.select(*by, "separation", F.col("n").alias("cells"), *scaled)


def consistency_report(points: DataFrame, by: Sequence[str], p: Consistency = Consistency()) -> DataFrame:
    """One row per group: points, windows, measurable, blocker, and offset, separation and cells of the nearest pairs, and the floor.

    The blocker is the first of: too few points, capture shorter than one window, no cell holds enough points, no surface was
    painted twice; null where a map can be measured.
    """
    if p.cell <= 0 or p.window <= 0:
        raise ValueError("bad configuration")
    seen = points.groupBy(*by).agg(F.count("*").alias("points"), F.min("t").alias("_0"), F.max("t").alias("_1"))
    key = [*by, *CELL, "w"]
    at = points.alias("l").join(seen.select(*by, "_0").alias("r"), _same(by)).select("l.*", F.floor((F.col("t") - F.col("_0")) / p.window).alias("w"))
    runs = spatial.with_cells(at, p.cell).groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") >= p.least)
    runs = runs.groupBy(*by).agg(F.count("*").alias("_runs"))
    levels = self_consistency(points, by, p)
    nearest = F.struct("separation", "median_offset", "cells")
    pick = levels.groupBy(*by).agg(
        F.min(F.when(F.col("separation") > 0, nearest)).alias("_near"),
        F.max(F.when(F.col("separation") == 0, F.struct("median_offset", "cells"))).alias("_self"),
    )
    all_ = seen
    for other, columns in ((runs, ["_runs"]), (pick, ["_near", "_self"])):
        all_ = all_.alias("l").join(other.alias("r"), _same(by), "left").select("l.*", *[f"r.{c}" for c in columns])
    blocker = (
        F.when(F.col("points") < 2 * p.least, "too few points")
        .when(F.col("_1") - F.col("_0") < p.window, "capture shorter than one window")
        .when(F.coalesce("_runs", F.lit(0)) < 2, "no cell holds enough points")
        .when(F.col("_near").isNull(), "no surface was painted twice")
    )
    return all_.select(
        *by, "points", (F.floor((F.col("_1") - F.col("_0")) / p.window) + 1).cast("long").alias("windows"), blocker.isNull().alias("measurable"), blocker.alias("blocker"),
        F.col("_near.separation").alias("nearest_separation"), F.col("_near.median_offset").alias("nearest_offset"), F.col("_near.cells").alias("cells"),
        F.col("_self.median_offset").alias("self_floor"), F.coalesce("_self.cells", F.lit(0)).alias("self_cells"),
    )


# ---- normals ---------------------------------------------------------------------------------------------------


def neighbour_moments(points: DataFrame, radius: float, by: Sequence[str] = (), k: int | None = None) -> DataFrame:
    """moments() of each point's neighbours within the radius (of a group; with k, of the k nearest), itself included; units are of the radius.

    points: by, id, x, y, z, one row an id. Sums are taken inside blocks of space, so no pair is shuffled.
    """
    keys = {c: points.schema[c].dataType.simpleString() for c in (*by, "id")}
    names = [f"s{a}" for a in AXES] + [f"s{a}{b}" for a, b in PAIRS]

    def sums(q: np.ndarray, t: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
        """Places of queries, the numbers of their neighbours in a part of the targets, and the parts of their sums."""
        for mine, other in spatial.near_boxes(q, t, radius):
            for n in range(0, len(other), 4096):  # products stay exact in doubles
                part = t[other[n : n + 4096]]
                d = [part[None, :, a] - q[mine][:, None, a] for a in range(3)]
                inside = d[0] * d[0] + d[1] * d[1] + d[2] * d[2] <= radius * radius
                u = [np.floor(c / radius * UNIT) * inside for c in d]
                yield mine, inside.sum(axis=1), [c.sum(axis=1) for c in u] + [np.einsum("ij,ij->i", u[AXES.index(a)], u[AXES.index(b)]) for a, b in PAIRS]

    def run(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        at, to = (d[list(AXES)].to_numpy(dtype=float) for d in (q, t))
        total = np.zeros((1 + len(names), len(q)), dtype=np.int64)
        if k is None:
            for mine, n, parts in sums(at, to):
                total[0, mine] += n
                for row, part in zip(total[1:], parts, strict=True):
                    row[mine] += part.astype(np.int64)
        else:
            a, b, _, _ = spatial.nearest(at, to, radius, k, np.argsort(np.argsort(t["id"].to_numpy(), kind="stable"), kind="stable"))
            u = np.floor((to[b] - at[a]) / radius * UNIT).astype(np.int64)
            parts = [np.ones(len(a), dtype=np.int64), *u.T, *[u[:, AXES.index(x)] * u[:, AXES.index(y)] for x, y in PAIRS]]
            for row, part in zip(total, parts, strict=True):
                np.add.at(row, a, part)
        return pd.DataFrame({**{c: q[c].to_numpy() for c in keys}, **dict(zip(["n", *names], total, strict=True))})

    schema = ", ".join(f"{c} {v}" for c, v in keys.items()) + "".join(f", {c} long" for c in ["n", *names])
    rows = points.select(*keys, *AXES)
    return spatial.around_blocks(rows, rows, radius, by, run, schema)


def normals(points: DataFrame, radius: float = 0.15, least: int = 6, clear: float = 0.0) -> DataFrame:
    """id, found, and the normal of each point's neighbourhood (itself included).

    It is null with fewer than ``least`` neighbours, and where the two smaller eigenvalues are closer than ``clear`` of the largest.
    """
    planes = with_planes(neighbour_moments(points, radius))
    enough = (F.col("n") >= least) & (F.col("e2") - F.col("e1") > clear * F.col("e3"))
    return planes.select("id", F.col("n").alias("found"), *[F.when(enough, F.col(f"n{a}")).alias(f"n{a}") for a in AXES])


def normal_coverage(points: DataFrame, by: Sequence[str], radius: float, k: int = 12, least: int = 6, thin: float = 0.1, least_points: int = 32, least_planes: int = 20) -> DataFrame:
    """By group: points, planes, coverage, weak direction. How well the normals of its surfaces span space.

    A point's plane is that of its k nearest neighbours within the radius; it counts if the smallest eigenvalue is at most
    ``thin`` of the next. Coverage is the smallest by the largest eigenvalue of the sum of n n': near 0, something can
    slide along the weak direction unseen. It is 0 with too few points or planes.
    """
    planes = with_planes(neighbour_moments(points, radius, by, k)).where((F.col("n") >= least) & (F.col("e2") > 1e-12) & (F.col("e1") <= thin * F.col("e2")) & F.col("nx").isNotNull())
    fine = float(1 << 30)
    sums = [F.sum(F.floor(F.col(f"n{a}") * F.col(f"n{b}") * fine).cast("long")).alias(f"c{a}{b}") for a, b in PAIRS]
    spread = with_eigen(planes.groupBy(*by).agg(F.count("*").alias("planes"), *sums))
    seen = points.groupBy(*by).agg(F.count("*").alias("points"))
    both = seen.alias("l").join(spread.alias("r"), _same(by), "left").select("l.*", "r.planes", *[f"r.{c}" for c in ("e1", "e3", "nx", "ny", "nz")])
    enough = (F.col("points") >= least_points) & (F.coalesce("planes", F.lit(0)) >= least_planes)
    return both.select(
        *by, "points", F.coalesce("planes", F.lit(0)).alias("planes"), F.when(enough, F.greatest(F.lit(0.0), F.col("e1") / F.col("e3"))).otherwise(0.0).alias("coverage"),
        *[F.when(enough, F.col(f"n{a}")).alias(f"weak_{a}") for a in AXES],
    )
