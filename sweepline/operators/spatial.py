"""Aggregates and joins on cells of space. Cells are bigint columns; nothing is packed, so no key can alias."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CELL = ("i", "j", "k")


def with_cells(points: DataFrame, size: float, axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """points with the cell of each row; rows with a null or NaN coordinate go."""
    finite = [F.col(a).isNotNull() & ~F.isnan(a) for a in axes]
    inverse = 1.0 / size
    kept = points.where(finite[0] if len(finite) == 1 else F.expr(" and ".join(f"{a} is not null and not isnan({a})" for a in axes)))
    return kept.withColumns({c: F.floor(F.col(a) * inverse).cast("long") for c, a in zip(CELL, axes, strict=False)})


def voxel_downsample(points: DataFrame, size: float, by: Sequence[str] = ()) -> DataFrame:
    """One mean point for each voxel (and group), with its number of points."""
    return (
        with_cells(points, size)
        .groupBy(*by, *CELL)
        .agg(*[F.avg(a).alias(a) for a in ("x", "y", "z")], F.count("*").alias("n"))
    )


def voxel_first(points: DataFrame, size: float, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The first point, by ``order``, of each voxel."""
    first = F.min(F.struct(*order, "x", "y", "z"))
    return with_cells(points, size).groupBy(*by, *CELL).agg(first.alias("f"), F.count("*").alias("n")).select(*by, *CELL, "f.*", "n")


def occupancy_grid(points: DataFrame, resolution: float, low: float, high: float, least: int) -> DataFrame:
    """Cells of the lattice that starts at the snapped minimum, with counts, inside an inclusive height band."""
    band = points.where(F.col("z").between(low, high))
    lattice = with_cells(band, resolution, ("x", "y")).groupBy("i", "j").agg(F.count("*").alias("n"))
    origin = lattice.agg(F.min("i").alias("i0"), F.min("j").alias("j0"))  # one row
    at = lattice.join(F.broadcast(origin), F.lit(True))
    return at.select((F.col("i") - F.col("i0")).alias("i"), (F.col("j") - F.col("j0")).alias("j"), "n", (F.col("n") >= least).alias("occupied"))


def wall_likeness(points: DataFrame, resolution: float, low: float, high: float, least_span: float) -> DataFrame:
    """Cells whose points in the band span a wall's height."""
    spans = with_cells(points.where(F.col("z").between(low, high)), resolution, ("x", "y")).groupBy("i", "j")
    return spans.agg((F.max("z") - F.min("z")).alias("span")).where(F.col("span") >= least_span)


def crispness(points: DataFrame, size: float, by: Sequence[str] = ()) -> DataFrame:
    """The number of occupied voxels."""
    return with_cells(points, size).groupBy(*by).agg(F.count_distinct(*CELL).alias("voxels"))


def revisit_overlap(points: DataFrame, size: float, apart: int) -> DataFrame:
    """The share of voxels whose points are at least ``apart`` from first to last time."""
    spans = with_cells(points, size).groupBy(*CELL).agg((F.max("t") - F.min("t")).alias("span"))
    return spans.agg(F.count("*").alias("voxels"), F.avg((F.col("span") >= apart).cast("double")).alias("overlap"))


def voxel_entropy(points: DataFrame, size: float) -> DataFrame:
    """Occupied voxels and the entropy, in bits, of how points fall on them (in one pass over the counts)."""
    n = with_cells(points, size).groupBy(*CELL).agg(F.count("*").cast("double").alias("n"))
    sums = n.agg(F.count("*").alias("voxels"), F.sum("n").alias("all"), F.sum(F.expr("n * log2(n)")).alias("s"))
    return sums.select("voxels", F.expr("log2(all) - s / all").alias("bits"))


def coverage(points: DataFrame, size: float, thin: int = 8, dense: int = 40) -> DataFrame:
    """Cells with a level from 0 (thin) to 1 (dense), linear in between."""
    n = with_cells(points, size, ("x", "y")).groupBy("i", "j").agg(F.count("*").alias("n"))
    level = F.when(F.col("n") <= thin, 0.0).when(F.col("n") >= dense, 1.0).otherwise((F.col("n") - thin) / float(dense - thin))
    return n.withColumn("level", level)


def coverage_compass(points: DataFrame, x0: float, y0: float, sectors: int = 12, thin: float = 0.15) -> DataFrame:
    """Points in each direction from a place, and whether a direction is thin against the mean of all."""
    bearing = F.degrees(F.atan2(F.col("x") - x0, F.col("y") - y0))
    sector = F.floor(F.when(bearing < 0, bearing + 360).otherwise(bearing) / (360.0 / sectors)).cast("int")
    counts = points.groupBy(F.least(sector, F.lit(sectors - 1)).alias("sector")).agg(F.count("*").alias("n"))
    every = points.sparkSession.range(sectors).select(F.col("id").cast("int").alias("sector"))
    full = every.join(counts, "sector", "left").fillna(0, ["n"])
    mean = F.sum("n").over(Window.partitionBy()) / float(sectors)  # as many rows as sectors
    return full.select("sector", "n", (F.col("n") < thin * mean).alias("thin"))


def _leaves(p: np.ndarray, most: int = 64) -> list[np.ndarray]:
    """The places of p (n, 3) in boxes of at most ``most`` points, halved along the longest side."""
    out, due = [], [np.arange(len(p))] if len(p) else []
    while due:
        k = due.pop()
        if len(k) <= most:
            out.append(k)
            continue
        half, axis = len(k) // 2, int(np.ptp(p[k], axis=0).argmax())
        k = k[np.argpartition(p[k, axis], half)]
        due += [k[:half], k[half:]]
    return out


def _squares(q: np.ndarray, t: np.ndarray) -> np.ndarray:
    d = [t[None, :, a] - q[:, None, a] for a in range(3)]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def near_boxes(q: np.ndarray, t: np.ndarray, radius: float, k: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of queries, box by box, and those of all targets that can be within the radius of one; with k, among its k nearest."""
    boxes = _leaves(t) if len(q) else []
    low, high = (np.array([f(t[b], axis=0) for b in boxes]) for f in (np.min, np.max))
    for mine in _leaves(q) if boxes else []:
        gap = np.maximum(0.0, np.maximum(low - q[mine].max(axis=0), q[mine].min(axis=0) - high))
        apart = (gap * gap).sum(axis=1) * (1 - 1e-9)  # so that rounding leaves no box out
        close = np.flatnonzero(apart <= radius * radius)
        if k is not None and len(close):
            close = close[np.argsort(apart[close])]
            few = close[: int(np.searchsorted(np.cumsum([len(boxes[b]) for b in close]), 4 * k)) + 1]
            d2 = _squares(q[mine], t[np.concatenate([boxes[b] for b in few])])
            if d2.shape[1] >= k:
                close = close[apart[close] <= np.partition(d2, k - 1, axis=1)[:, k - 1].max()]
        if len(close):
            yield mine, np.concatenate([boxes[b] for b in close])


def nearest(q: np.ndarray, t: np.ndarray, radius: float, k: int, order: np.ndarray) -> tuple[np.ndarray, ...]:
    """Query, target, rank (from 1) and squared distance of the k nearest targets within the radius, equal ones by ``order``."""
    found = [(np.zeros(0, int),) * 3 + (np.zeros(0),)]
    for mine, other in near_boxes(q, t, radius, k):
        d2 = _squares(q[mine], t[other])
        last = np.partition(d2, k - 1, axis=1)[:, k - 1] if d2.shape[1] > k else np.full(len(mine), np.inf)
        row, col = np.nonzero((d2 <= last[:, None]) & (d2 <= radius * radius))
        d2 = d2[row, col]
        by = np.lexsort((order[other[col]], d2, row))
        row, col, d2 = row[by], col[by], d2[by]
        rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
        kept = rank <= k
        found.append((mine[row[kept]], other[col[kept]], rank[kept], d2[kept]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def around_blocks(queries: DataFrame, targets: DataFrame, radius: float, by: Sequence[str], run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """run(queries, targets) for each block of space, two radii wide: its own queries, and the targets in it or within the radius of it.

    A target travels once for each block it can matter to, at most eight; pairs stay inside the groups. Rows with a null or
    NaN coordinate, or a null in ``by``, go.
    """
    width, reach = 2.0 * radius, radius * (1 + 1e-9)
    whole = " and ".join([f"{a} is not null and not isnan({a})" for a in "xyz"] + [f"{c} is not null" for c in by])
    own = queries.where(whole).withColumns({c: F.floor(F.col(a) / width).cast("long") for c, a in zip(CELL, "xyz", strict=True)})
    met = targets.where(whole)
    for c, a in zip(CELL, "xyz", strict=True):
        met = met.withColumn(c, F.explode(F.sequence(*[F.floor((F.col(a) + s * reach) / width).cast("long") for s in (-1, 1)])))
    both = own.withColumn("_asks", F.lit(True)).unionByName(met.withColumn("_asks", F.lit(False)), True)

    def each(group: pd.DataFrame) -> pd.DataFrame:
        return run(group[group["_asks"]], group[~group["_asks"]])

    return both.groupBy(*by, *CELL).applyInPandas(each, schema)


def knn(queries: DataFrame, targets: DataFrame, radius: float, k: int, order: Sequence[str]) -> DataFrame:
    """The k nearest targets of each query within the radius, ties in ``order``; column rank from 1.

    queries: (q, x, y, z), one row a q. targets: order columns, x, y, z. Result: q, d2, the order columns, rank.
    """
    kinds = {"q": queries.schema["q"].dataType.simpleString()} | {f"t_{c}": targets.schema[c].dataType.simpleString() for c in order}

    def run(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values([f"t_{c}" for c in order], kind="stable")
        a, b, rank, d2 = nearest(*(d[["x", "y", "z"]].to_numpy(dtype=float) for d in (q, t)), radius, k, np.arange(len(t)))
        return pd.DataFrame({"q": q["q"].to_numpy()[a], "d2": d2, **{c: t[c].to_numpy()[b] for c in list(kinds)[1:]}, "rank": rank.astype(np.int32)})

    schema = f"q {kinds['q']}, d2 double, " + ", ".join(f"{c} {v}" for c, v in list(kinds.items())[1:]) + ", rank int"
    sent = targets.select("x", "y", "z", *[F.col(c).alias(f"t_{c}") for c in order])
    found = around_blocks(queries.select("q", "x", "y", "z"), sent, radius, [], run, schema)
    return found.select("q", "d2", *[F.col(f"t_{c}").alias(c) for c in order], "rank")


def outlier_filter(points: DataFrame, radius: float, k: int = 8, least: int = 3, sigmas: float = 1.5) -> DataFrame:
    """id, found, mean_d and status of each point (id, x, y, z): isolated, outlier or kept.

    A point finds itself, so k + 1 are asked for. Mean and population deviation are of the points that aren't isolated.
    """
    queries = points.select(F.col("id").alias("q"), "x", "y", "z")
    near = knn(queries, points, radius, k + 1, ["id"])
    each = near.groupBy("q").agg(F.count("*").alias("found"), F.sum(F.sqrt("d2")).alias("total"))
    each = each.withColumn("mean_d", F.when(F.col("found") > least, F.col("total") / (F.col("found") - 1)))
    limit = each.agg((F.avg("mean_d") + sigmas * F.stddev_pop("mean_d")).alias("limit"))  # one row
    return each.join(F.broadcast(limit), F.lit(True)).select(
        F.col("q").alias("id"),
        "found",
        "mean_d",
        F.when(F.col("mean_d").isNull(), "isolated").when(F.col("mean_d") > F.col("limit"), "outlier").otherwise("kept").alias("status"),
    )


def overlap(a: DataFrame, b: DataFrame, pitch: float) -> DataFrame:
    """Both ways: the share of points that have an occupied voxel of the other cloud within half a pitch; and the least."""
    corners = list(product((0, 1), repeat=3))

    def share(p: DataFrame, q: DataFrame, name: str) -> DataFrame:
        occupied = with_cells(q, pitch).select(*CELL).distinct()
        shifted = with_cells(p.select(*[(F.col(c) - pitch / 2).alias(c) for c in ("x", "y", "z")]), pitch)
        cells = shifted.groupBy(*CELL).agg(F.count("*").alias("n"))
        around = F.array(*[F.struct(*[(F.col(c) + s).alias(f"n{c}") for c, s in zip(CELL, d, strict=True)]) for d in corners])
        probes = cells.select(*CELL, "n", F.explode(around).alias("p")).select(*CELL, "n", "p.*")
        hits = probes.join(occupied.toDF("ni", "nj", "nk"), ["ni", "nj", "nk"], "left_semi").select(*CELL).distinct()
        found = cells.join(hits.withColumn("hit", F.lit(1)), list(CELL), "left")
        return found.agg((F.sum(F.when(F.col("hit") == 1, F.col("n"))) / F.sum("n")).alias(name))

    both = share(a, b, "a_in_b").join(share(b, a, "b_in_a"), F.lit(True))  # one row each
    return both.withColumn("overlap", F.least("a_in_b", "b_in_a"))


def bounds(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return points.groupBy(*by).agg(*[f(a).alias(f"{n}_{a}") for n, f in (("min", F.min), ("max", F.max)) for a in ("x", "y", "z")], F.count("*").alias("n"))


def histogram(points: DataFrame, column: str, width: float, by: Sequence[str] = ()) -> DataFrame:
    return points.groupBy(*by, F.floor(F.col(column) / width).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def best_shift(a: DataFrame, b: DataFrame, most: int) -> DataFrame:
    """shift and score of every shift of histogram b against a (bin, n), best first by rank."""
    shifts = F.explode(F.sequence(F.lit(-most).cast("long"), F.lit(most).cast("long")))
    moved = b.select(shifts.alias("shift"), "bin", F.col("n").alias("m")).withColumn("bin", F.col("bin") + F.col("shift"))
    score = moved.join(a, "bin").groupBy("shift").agg(F.sum(F.col("n") * F.col("m")).alias("score"))
    return score.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.abs("shift"), "shift")))  # 2 * most + 1 rows


def ring_sector(points: DataFrame, rings: int = 20, sectors: int = 60, reach: float = 80.0) -> DataFrame:
    """The highest point of each ring and sector around the origin, for one frame or for each ``frame``."""
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    a = F.degrees(F.atan2("y", "x"))
    sector = F.floor(F.when(a < 0, a + 360).otherwise(a) / (360.0 / sectors)).cast("int")
    return (
        points.where(r < reach)
        .groupBy("frame", F.floor(r / (reach / rings)).cast("int").alias("ring"), F.least(sector, F.lit(sectors - 1)).alias("sector"))
        .agg(F.max("z").alias("top"))
    )


def plane_fit(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """n, mean and covariance of each group: the sums that a principal-component plane needs."""
    axes = ("x", "y", "z")
    pairs = [(a, b) for i, a in enumerate(axes) for b in axes[i:]]
    return points.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(a).alias(f"m{a}") for a in axes], *[F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in pairs])


def eigenvalues_2d(cxx: Column, cxy: Column, cyy: Column) -> tuple[Column, Column]:
    """The larger and the smaller eigenvalue of a symmetric 2 x 2 matrix."""
    mean, half = (cxx + cyy) / 2, F.sqrt(F.pow((cxx - cyy) / 2, F.lit(2)) + cxy * cxy)
    return mean + half, mean - half
