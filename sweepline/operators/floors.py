"""The floor of a map, and levelling a map by it. Height is y.

Plane hypotheses are a fixed table of each group: triples from the points of its low band with the least hashes. One aggregate
counts the points near every hypothesis, so the winner is the same for any order and any partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sweepline.functions import geometry
from sweepline.operators import poses as posing
from sweepline.operators import surfaces
from sweepline.operators.poses import P, Q
from sweepline.session import checkpointed

#: Units of a metre in which sums are taken, exactly.
FINE = float(1 << 16)


@dataclass(frozen=True)
class Level:
    #: Fixed values.
    band: float = 0.25
    below: float = 0.05
    tolerance: float = 0.02
    hypotheses: int = 500
    least_band: int = 500
    least_points: int = 1000
    least_inliers: int = 1500
    least_area: float = 1.0
    cell: float = 0.25
    least_tilt: float = 1.5
    most_tilt: float = 15.0
    done_tilt: float = 0.3
    rounds: int = 4
    worse: float = 0.0
    consistency: surfaces.Consistency = field(default_factory=surfaces.Consistency)
    #: Seed of the hypotheses.
    seed: int = 1


def _with(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """left with the other columns of right, which has one row for a group; nulls are equal."""
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return left.alias("l").join(right.alias("r"), same, how).select("l.*", *[f"r.{c}" for c in right.columns if c not in by])


def low_band(points: DataFrame, by: Sequence[str], p: Level) -> DataFrame:
    """The points of each group that lie low: from just under the first hundredth of heights up to a share of the span."""
    span = surfaces.picked(points.select(*by, "y"), by, "y", {"_low": 0.01, "_high": 0.99}, 0.01, nearest=True)
    at = _with(points, span.select(*by, "_low", (F.col("_low") + p.band * (F.col("_high") - F.col("_low"))).alias("_top")), by)
    return at.where((F.col("y") > F.col("_low") - p.below) & (F.col("y") < F.col("_top"))).drop("_low", "_top")


def hypotheses(band: DataFrame, by: Sequence[str], p: Level) -> DataFrame:
    """by, h, and the plane nx x + ny y + nz z + d = 0 through each seeded triple that faces up, within 45 degrees.

    A group has at most ``p.hypotheses`` of them, each of three of its ``p.hypotheses`` seeded points.
    """
    whole = F.concat_ws(",", F.lit(p.seed), *[F.floor(F.col(a) * FINE).cast("string") for a in "xyz"])
    order = Window.partitionBy(*by).orderBy(F.md5(whole), "x", "y", "z")
    seeds = band.select(*by, "x", "y", "z").distinct().withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= p.hypotheses)
    lists = seeds.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_r", "x", "y", "z"))).alias("_s"))
    n = F.size("_s")
    triples = lists.select(*by, "_s", F.explode(F.sequence(F.lit(0), F.lit(p.hypotheses - 1))).alias("h"))
    pick = lambda a, b: F.col("_s")[((F.col("h") * a + b) % n).cast("int")]
    t = triples.select(*by, "h", pick(1, 0).alias("a"), pick(7, 1).alias("b"), pick(13, 5).alias("c"))
    ab, ac = ([F.col(f"{k}.{x}") - F.col(f"a.{x}") for x in "xyz"] for k in "bc")
    cross = (ab[1] * ac[2] - ab[2] * ac[1], ab[2] * ac[0] - ab[0] * ac[2], ab[0] * ac[1] - ab[1] * ac[0])
    t = t.select(*by, "h", "a", *[c.alias(f"_{x}") for c, x in zip(cross, "xyz", strict=True)])
    size = F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y") + F.col("_z") * F.col("_z"))
    t = t.withColumn("_k", F.when(F.col("_y") < 0, -1.0).otherwise(1.0) / F.nullif(size, F.lit(0.0)))
    t = t.select(*by, "h", "a", *[(F.col(f"_{x}") * F.col("_k")).alias(f"n{x}") for x in "xyz"]).where(F.col("ny") >= 0.70710678)
    return t.select(*by, "h", "nx", "ny", "nz", (-(F.col("nx") * F.col("a.x") + F.col("ny") * F.col("a.y") + F.col("nz") * F.col("a.z"))).alias("d"))


def _distance() -> Column:
    return F.abs(F.col("nx") * F.col("x") + F.col("ny") * F.col("y") + F.col("nz") * F.col("z") + F.col("d"))


def floor_planes(points: DataFrame, by: Sequence[str], p: Level = Level()) -> DataFrame:
    """One row per group: points, state, inliers, area, tilt (degrees) and the floor's unit normal nx, ny, nz, upward.

    points: by, x, y, z. The state is the first that holds of: not-enough-data, no-floor, thin-floor, found. Normal, area and tilt
    are of the inliers' principal plane; they are null without a floor.
    """
    finite = " and ".join(f"{a} is not null and not isnan({a})" for a in "xyz")
    seen = points.groupBy(*by).agg(F.count("*").alias("points"))
    band = low_band(points.where(finite).select(*by, "x", "y", "z"), by, p)
    enough = band.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") >= p.least_band).drop("_n")
    band = checkpointed(_with(band, enough, by))
    planes = hypotheses(band, by, p)
    scores = _with_all(band, planes, by).where(_distance() < p.tolerance).groupBy(*by, "h").agg(F.count("*").alias("_n"))
    best = scores.groupBy(*by).agg(F.max(F.struct("_n", (-F.col("h")).alias("_h"))).alias("_b")).where("_b._n >= 3")
    best = best.select(*by, (-F.col("_b._h")).alias("h")).alias("l").join(planes.alias("r"), surfaces._same([*by, "h"])).select("r.*").drop("h")
    near = _with(band, best, by).where(_distance() < p.tolerance).drop("nx", "ny", "nz", "d")
    whole = {a: F.floor(F.col(a) * FINE).cast("decimal(18,0)") for a in "xyz"}
    sums = [F.sum(whole[a]).alias(f"s{a}") for a in "xyz"] + [F.sum(whole[a] * whole[b]).alias(f"s{a}{b}") for a, b in surfaces.PAIRS]
    cells = near.select(*by, F.floor(F.col("x") / p.cell).alias("i"), F.floor(F.col("z") / p.cell).alias("k")).distinct().groupBy(*by).agg(F.count("*").alias("_cells"))
    fit = near.groupBy(*by).agg(F.count("*").alias("inliers"), *sums)
    n = F.col("inliers")
    # n S_ab - S_a S_b in whole numbers: nothing is lost where a floor lies far from the origin
    spread = {f"c{a}{b}": (n * F.col(f"s{a}{b}") - F.col(f"s{a}") * F.col(f"s{b}")).cast("double") / n / n / FINE / FINE for a, b in surfaces.PAIRS}
    fit = surfaces.with_eigen(fit.select(*by, "inliers", *[c.alias(k) for k, c in spread.items()]))
    up = F.when(F.col("ny") < 0, -1.0).otherwise(1.0)
    fit = _with(fit, cells, by).select(
        *by, "inliers", (F.col("_cells") * (p.cell * p.cell)).alias("area"), *[(F.col(f"n{a}") * up).alias(f"n{a}") for a in "xyz"],
        F.degrees(F.acos(F.least(F.lit(1.0), F.abs("ny")))).alias("tilt"),
    )
    all_ = _with(seen, fit, by, "left")
    state = (
        F.when(F.col("points") < p.least_points, "not-enough-data")
        .when(F.col("tilt").isNull(), "no-floor")
        .when((F.col("inliers") < p.least_inliers) | (F.col("area") < p.least_area), "thin-floor")
        .otherwise("found")
    )
    return all_.select(*by, "points", state.alias("state"), "inliers", "area", "tilt", "nx", "ny", "nz")


def _with_all(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """left with each of the group's rows of right, a bounded list that travels as one row."""
    rest = [c for c in right.columns if c not in by]
    lists = right.groupBy(*by).agg(F.collect_list(F.struct(*rest)).alias("_l"))
    return _with(left, lists, by).withColumn("_e", F.explode("_l")).select(*left.columns, "_e.*")


# ---- levelling -------------------------------------------------------------------------------------------------


def _upright() -> geometry.Quaternion:
    """The turn about a horizontal axis that takes nx, ny, nz to the vertical; it has no part about it."""
    flat = F.sqrt(F.col("nx") * F.col("nx") + F.col("nz") * F.col("nz"))
    half = F.acos(F.least(F.lit(1.0), F.abs("ny"))) / 2
    k = F.when(flat > 0, F.sin(half) / F.nullif(flat, F.lit(0.0))).otherwise(0.0)
    # the axis is n x up
    return -F.col("nz") * k, F.lit(0.0), F.col("nx") * k, F.cos(half)


def mean_attitude(poses: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, mx..mw: the mean attitude of tracked poses, each on the side of the group's first."""
    kept = poses.where(~F.coalesce("lost", F.lit(False)) & (F.coalesce("quality", F.lit(1)) != 0))
    first = kept.groupBy(*by).agg(F.min_by(F.struct(*Q), F.struct("t", *Q)).alias("_f"))
    side = sum((F.col(c) * F.col(f"_f.{c}") for c in Q[1:]), F.col(Q[0]) * F.col(f"_f.{Q[0]}"))
    sums = _with(kept, first, by).groupBy(*by).agg(*[F.sum(F.when(side < 0, -F.col(c)).otherwise(F.col(c))).alias(f"_{c}") for c in Q])
    size = F.sqrt(sum((F.col(f"_{c}") * F.col(f"_{c}") for c in Q[1:]), F.col(f"_{Q[0]}") * F.col(f"_{Q[0]}")))
    return sums.withColumn("_s", size).where("_s > 1e-12").select(*by, *[(F.col(f"_{c}") / F.col("_s")).alias(f"m{c[1]}") for c in Q])


def _attitudes(points: DataFrame, poses: DataFrame, by: str, bucket: int) -> DataFrame:
    """points with the pose at their time; before the first and after the last pose, with that one."""
    found = posing.posed(points, poses, by, bucket)
    for c in (*P, *Q):
        found = found.withColumn(c, F.coalesce(c, f"before.{c}", f"after.{c}"))
    return found.select(*points.columns, *P, *Q)


def levelled(points: DataFrame, poses: DataFrame, by: str, bucket: int, p: Level = Level()) -> tuple[DataFrame, DataFrame]:
    """Points turned until their floor is level, and a report of each group.

    points: by, t, x, y, z and others; poses: by, t, px..pz, qx..qw, sigma, quality, lost, confidence. The error is a trim of the
    sensor, so one turn of the carrier's frame goes to every point through the pose at its time: p' = t + R dq R' (p - t). It
    comes from the floor's normal at the mean attitude, has no part about the vertical, and is refined in up to ``p.rounds`` rounds,
    which all groups share. Report: by, decision (applied, already-level, tilt-too-big, not-enough-data, no-floor, thin-floor,
    no-improvement, ruler-says-worse), tilt_before, tilt_after, rounds, the correction cx..cw and its angle. Points of groups
    that are not applied come back as they were.
    """
    key = [by]
    first = checkpointed(floor_planes(points, key, p))
    mean = mean_attitude(poses, key)
    now = _with(first, mean, key, "left").select(
        by, "state", F.col("tilt").alias("tilt_before"), "tilt", "nx", "ny", "nz", *[f"m{c[1]}" for c in Q],
        *[F.lit(v).alias(f"c{k}") for k, v in zip("xyzw", (0.0, 0.0, 0.0, 1.0), strict=True)], F.lit(0).alias("rounds"),
    )
    wanted = (F.col("state") == "found") & F.col("mw").isNotNull() & F.col("tilt_before").between(p.least_tilt, p.most_tilt)
    now = checkpointed(now.withColumn("wanted", F.coalesce(wanted, F.lit(False))))
    at = checkpointed(_attitudes(_with(points, now.where("wanted").select(by), key), poses, by, bucket))
    for _ in range(p.rounds):
        due = now.where(F.col("wanted") & (F.col("tilt") > p.done_tilt))
        if not due.take(1):
            break
        m = tuple(F.col(f"m{c}") for c in "xyzw")
        turn = geometry.multiplied(geometry.multiplied(geometry.conjugate(m), _upright()), m)
        turns = checkpointed(due.select(by, *[c.alias(f"d{k}") for c, k in zip(turn, "xyzw", strict=True)]))
        d, c = (tuple(F.col(f"{k}{x}") for x in "xyzw") for k in "dc")
        at = checkpointed(_turned(at, turns, by))
        fits = floor_planes(at, key, p).select(by, F.col("tilt").alias("_tilt"), *[F.col(f"n{a}").alias(f"_n{a}") for a in "xyz"])
        joined = _with(_with(now, turns, key, "left"), fits, key, "left")
        step = F.col("dw").isNotNull()
        ok = step & F.col("_tilt").isNotNull()
        composed = geometry.multiplied(d, c)
        changes = {f"c{k}": F.when(step, x).otherwise(F.col(f"c{k}")) for k, x in zip("xyzw", composed, strict=True)}
        changes |= {k: F.when(ok, F.col(f"_{k}")).otherwise(F.col(k)) for k in ("tilt", "nx", "ny", "nz")}
        changes["rounds"] = F.when(step, F.col("rounds") + 1).otherwise(F.col("rounds"))
        now = checkpointed(joined.withColumns(changes).select(now.columns))
    ruler = lambda df, name: surfaces.consistency_report(df, key, p.consistency).select(by, F.col("nearest_offset").alias(name))
    now = _with(_with(now, ruler(_with(points, now.where("wanted").select(by), key), "_was"), key, "left"), ruler(at, "_is"), key, "left")
    worse = F.col("_was").isNotNull() & (F.col("_is").isNull() | (F.col("_is") > F.col("_was") + p.worse))
    decision = (
        F.when(F.col("state") != "found", F.col("state"))
        .when(F.col("mw").isNull(), "not-enough-data")
        .when(F.col("tilt_before") < p.least_tilt, "already-level")
        .when(F.col("tilt_before") > p.most_tilt, "tilt-too-big")
        .when(~(F.col("tilt") < F.col("tilt_before")), "no-improvement")
        .when(worse, "ruler-says-worse")
        .otherwise("applied")
    )
    size = F.sqrt(sum((F.col(f"c{k}") * F.col(f"c{k}") for k in "yzw"), F.col("cx") * F.col("cx")))
    report = now.withColumns({"decision": decision, "_s": size}).select(
        by, "decision", "tilt_before", F.col("tilt").alias("tilt_after"), "rounds",
        *[F.when(F.col("decision") == "applied", F.col(f"c{k}") / F.col("_s")).otherwise(1.0 if k == "w" else 0.0).alias(f"c{k}") for k in "xyzw"],
    )
    report = checkpointed(report.withColumn("angle", F.degrees(2 * F.acos(F.least(F.lit(1.0), F.abs("cw"))))))
    moved = report.where("decision = 'applied'").select(by)
    same = F.col(f"l.{by}").eqNullSafe(F.col(f"r.{by}"))
    kept = points.alias("l").join(moved.alias("r"), same, "left_anti")
    return kept.unionByName(_with(at.select(points.columns), moved, key)), report


def _turned(at: DataFrame, turns: DataFrame, by: str) -> DataFrame:
    """Posed points moved by their group's turn dx..dw of the carrier's frame; points of other groups stay."""
    joined = _with(at, turns, [by], "left")
    q, d = posing.quaternion(), tuple(F.col(f"d{k}") for k in "xyzw")
    world = geometry.multiplied(geometry.multiplied(q, d), geometry.conjugate(q))
    moved = geometry.rotated(world, *[F.col(a) - F.col(f"p{a}") for a in "xyz"])
    return joined.withColumns({a: F.when(F.col("dw").isNotNull(), v + F.col(f"p{a}")).otherwise(F.col(a)) for a, v in zip("xyz", moved, strict=True)}).select(at.columns)
