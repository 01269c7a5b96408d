"""Operators on poses: as-of joins with attitudes, gyro bridges, sections and their corrections, keyframes, thinning."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sweepline.functions import geometry
from sweepline.operators import asof
from sweepline.operators.prefix import with_previous

Q = ("qx", "qy", "qz", "qw")
P = ("px", "py", "pz")


def quaternion(prefix: str = "") -> geometry.Quaternion:
    return tuple(F.col(prefix + c) for c in Q)  # type: ignore[return-value]


def posed(probes: DataFrame, knots: DataFrame, by: str, bucket: int, offset: int = 0) -> DataFrame:
    """probes with the pose at t + offset: px..pz on the line, qx..qw on the short arc, and the worse end's sigma, quality, lost, confidence.

    knots: (by, t, px..pz, qx..qw, sigma, quality, lost, confidence). ``before`` and ``after`` stay, for a gate.
    """
    shifted = probes.withColumn("t", F.col("t") + offset)
    found = asof.brackets(shifted, knots, by, [*P, *Q, "sigma", "quality", "lost", "confidence"], bucket)
    u, hit = asof.fraction(), F.col("before.t") == F.col("after.t")
    arc = geometry.slerp(quaternion("before."), quaternion("after."), u)
    turned = [F.when(hit, F.col(f"before.{c}")).otherwise(a) for c, a in zip(Q, arc, strict=True)]
    both = F.col("before").isNotNull() & F.col("after").isNotNull()
    worse = {
        "sigma": F.greatest("before.sigma", "after.sigma"), "quality": F.least("before.quality", "after.quality"),
        "lost": F.col("before.lost") | F.col("after.lost"), "confidence": F.least("before.confidence", "after.confidence"),
    }
    made = {c: asof.interpolated(c) for c in P} | dict(zip(Q, turned, strict=True)) | worse
    return found.withColumns({n: F.when(both, c) for n, c in made.items()}).withColumn("t", F.col("t") - offset)


def pose_gate(max_gap: int, least_confidence: float = 0.35) -> Column:
    """The state of posed() rows, the worst first; an invalid end outweighs a lost one."""
    return asof.gate(max_gap, least_confidence, F.col("quality") == 0, F.col("lost"))


def assembled(rows: DataFrame, mount: Sequence[float], angle: Column, distance: Column, state: Column, keep_flagged: bool = False) -> DataFrame:
    """posed() rows with the world point wx..wz of a fan return behind a mount, ``alpha`` and ``state``.

    Rows of another state than ok are dropped, or kept with an alpha of 96; those without a pose always go.
    """
    local = geometry.transformed(mount, *geometry.fan(angle, distance))
    turned = geometry.rotated(quaternion(), *local)
    at = rows.withColumn("state", state).where(F.col("px").isNotNull())
    at = at if keep_flagged else at.where("state = 'ok'")
    points = {f"w{a}": t + F.col(f"p{a}") for a, t in zip("xyz", turned, strict=True)}
    return at.withColumns(points | {"alpha": F.when(F.col("state") == "ok", 255).otherwise(96)})


# ---- gyro ----------------------------------------------------------------------------------------------------


def _as_struct(q: Sequence[Column]) -> Column:
    return F.struct(*[c.alias(n) for n, c in zip(Q, q, strict=True)])


def _turn(w: Sequence[Column], dt: Column) -> geometry.Quaternion:
    """The quaternion of a rotation vector; exact for short ones as well."""
    square = sum((c * c for c in w[1:]), w[0] * w[0])
    half = F.sqrt(square) * dt / 2
    small = half < 1e-9
    k = F.when(small, dt / 2).otherwise(F.sin(half) / F.nullif(F.sqrt(square), F.lit(0.0)))
    return w[0] * k, w[1] * k, w[2] * k, F.cos(half)


def gyro_bridge(gaps: DataFrame, gyro: DataFrame, by: str, max_gap: int, bucket: int, second: float = 1e6) -> DataFrame:
    """gaps (by, t0, t1, ...) with qx..qw, the rotation between their ends, ``peak`` (rad/s), ``hole`` and ``covered``.

    gyro: (by, t, gx, gy, gz), rad/s. Rates are averaged between samples. A hole is a stretch of more than max_gap without a
    sample. Only the samples of a gap, and the ones just around it, meet it, by time buckets; products are taken in
    order inside the row of the gap, whose length the caller bounds.
    """
    marked = gaps.withColumn("_gap", F.monotonically_increasing_id())
    spread = marked.select(by, "_gap", "t0", "t1", F.explode(F.sequence(F.floor((F.col("t0") - max_gap) / bucket), F.floor((F.col("t1") + max_gap) / bucket))).alias("_b"))
    at = gyro.withColumn("_b", F.floor(F.col("t") / bucket)).select(by, "_b", "t", "gx", "gy", "gz")
    near = spread.join(at, [by, "_b"]).where("t >= t0 - {0} and t <= t1 + {0}".format(max_gap))
    lists = near.groupBy(by, "_gap").agg(F.sort_array(F.collect_list(F.struct("t", "gx", "gy", "gz"))).alias("_s"))
    rows = marked.join(lists, [by, "_gap"], "left").withColumn("_s", F.coalesce("_s", F.array().cast("array<struct<t: bigint, gx: double, gy: double, gz: double>>")))
    entry = "struct<q: struct<qx: double, qy: double, qz: double, qw: double>, t: bigint, gx: double, gy: double, gz: double, peak: double, hole: boolean>"
    zero = F.lit(0.0)
    nothing = F.lit(None).cast("double")
    start = F.struct(_as_struct((zero, zero, zero, F.lit(1.0))).alias("q"), F.col("t0").cast("long").alias("t"), nothing.alias("gx"), nothing.alias("gy"), nothing.alias("gz"), zero.alias("peak"), F.lit(False).alias("hole")).cast(entry)

    def step(a: Column, s: Column) -> Column:
        upto = F.least(s["t"], F.col("t1"))
        rates = F.struct(*[F.coalesce((a[c] + s[c]) / 2, s[c]).alias(c) for c in ("gx", "gy", "gz")], (F.greatest(upto - a["t"], F.lit(0)) / second).alias("dt"))

        def moved(w: Column) -> Column:
            turn = _as_struct(_turn([w[c] for c in ("gx", "gy", "gz")], w["dt"]))
            q = geometry.let(turn, lambda d: _as_struct(geometry.multiplied(tuple(a["q"][c] for c in Q), tuple(d[c] for c in Q))))  # type: ignore[arg-type]
            rate = F.sqrt(w["gx"] * w["gx"] + w["gy"] * w["gy"] + w["gz"] * w["gz"])
            return F.struct(
                q.alias("q"), upto.alias("t"), s["gx"].alias("gx"), s["gy"].alias("gy"), s["gz"].alias("gz"),
                F.greatest(a["peak"], rate).alias("peak"), (a["hole"] | (upto - a["t"] > max_gap)).alias("hole"),
            ).cast(entry)

        still = F.struct(a["q"].alias("q"), a["t"].alias("t"), s["gx"].alias("gx"), s["gy"].alias("gy"), s["gz"].alias("gz"), a["peak"].alias("peak"), a["hole"].alias("hole")).cast(entry)
        return F.when((upto > a["t"]) & (s["t"] > F.col("t0")), geometry.let(rates, moved)).otherwise(still)

    done = rows.withColumn("_g", F.aggregate("_s", start, step))
    covered = (F.size("_s") > 0) & (F.col("_g.t") >= F.col("t1") - max_gap)
    q = geometry.normalised(tuple(F.col(f"_g.q.{c}") for c in Q))  # type: ignore[arg-type]
    return done.withColumns(dict(zip(Q, q, strict=True)) | {"peak": F.col("_g.peak"), "hole": F.col("_g.hole") | (F.col("_g.t") < F.col("t1")), "covered": covered}).drop("_g", "_s", "_gap")


# ---- sections ------------------------------------------------------------------------------------------------


def seams(poses: DataFrame, by: str, order: Sequence[str], bucket: Column, max_speed: float = 6.0, max_turn: float = 400.0, least: float = 0.008, snap: float = 0.1, second: float = 1e6) -> DataFrame:
    """Where sections of a track may begin: (by, t, gap, distance, turn, impossible) and the poses before and after.

    Lost poses and those without quality are passed over. Between neighbours an impossible speed or turn is a seam; a gap longer
    than ``snap`` seconds, across poses passed over or without any, is one of its own.
    """
    at = poses.withColumn("_good", ~F.col("lost") & (F.col("quality") > 0))
    at = with_previous(at, [by], order, {"_neighbour": "_good"}, bucket)
    good = at.where("_good")
    good = with_previous(good, [by], order, {f"b_{c}": c for c in ("t", *P, *Q)}, bucket)
    dt = (F.col("t") - F.col("b_t")) / second
    moved = F.sqrt(sum(((F.col(c) - F.col(f"b_{c}")) * (F.col(c) - F.col(f"b_{c}")) for c in P[1:]), (F.col("px") - F.col("b_px")) * (F.col("px") - F.col("b_px"))))
    made = good.withColumns({"gap": dt, "distance": moved, "turn": geometry.turn_degrees(quaternion("b_"), quaternion())})
    impossible = F.col("_neighbour") & ((F.col("distance") / F.col("gap") > max_speed) | (F.col("turn") / F.col("gap") > max_turn))
    found = made.where(F.col("gap") > least).withColumn("impossible", F.coalesce(impossible, F.lit(False)))
    return found.where(F.col("impossible") | (F.col("gap") > snap)).drop("_good", "_neighbour")


def reanchor_verdict(gap: Column, turn: Column, distance: Column, gyro_turn: Column, gyro_rest: Column, has_gyro: Column, snap: float = 0.1, longest: float = 8.0, walk: float = 1.8, slack: float = 0.3,
                     most_turn: float = 25.0, most_shift: float = 2.0, least_turn: float = 0.25, least_shift: float = 0.01) -> Column:
    """What to make of a gap: snap, refused_too_long, refused_no_gyro, refused_disagrees, negligible or bridged.

    gyro_rest: degrees between the reported attitude and the one that the gyro predicts. What a walk can't explain of the
    shift, and that rest, are the correction.
    """
    excess = F.greatest(F.lit(0.0), distance - (walk * gap + slack))
    return (
        F.when((gap <= snap) & (turn <= most_turn), "snap")
        .when(gap > longest, "refused_too_long")
        .when(~has_gyro | gyro_turn.isNull(), "refused_no_gyro")
        .when((gyro_rest > most_turn) | (excess > most_shift), "refused_disagrees")
        .when((gyro_rest < least_turn) & (excess < least_shift), "negligible")
        .otherwise("bridged")
    )


IDENTITY = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]


def matrix_product(a: Column, b: Column) -> Column:
    """Row-major 4 x 4 arrays."""
    cell = lambda k: sum((a[(F.floor(k / 4) * 4 + i).cast("int")] * b[(k % 4 + 4 * i).cast("int")] for i in range(1, 4)), a[(F.floor(k / 4) * 4).cast("int")] * b[(k % 4).cast("int")])
    return F.transform(F.sequence(F.lit(0), F.lit(15)), cell)


def composed_backwards(corrections: DataFrame, by: str) -> DataFrame:
    """(by, section, matrix): what brings each section into the frame of its session's last one.

    corrections: (by, section, matrix), the matrix taking the section before into this one. Sections are few to a session.
    """
    lists = corrections.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("section", "matrix")), False).alias("_c"))
    one = F.array(*[F.lit(x) for x in IDENTITY])
    state = "array<struct<section: bigint, matrix: array<double>>>"
    start = F.array(F.struct((F.col("_c")[0]["section"]).cast("long").alias("section"), one.alias("matrix"))).cast(state)

    def step(out: Column, c: Column) -> Column:
        last = F.element_at(out, -1)["matrix"]
        return F.concat(out, F.array(F.struct((c["section"] - 1).cast("long").alias("section"), matrix_product(last, c["matrix"]).alias("matrix")))).cast(state)

    return lists.select(by, F.explode(F.aggregate("_c", start, step)).alias("s")).select(by, "s.section", "s.matrix")


def moved_by(matrix: Column, x: Column, y: Column, z: Column) -> list[Column]:
    return geometry.transformed([matrix[i] for i in range(16)], x, y, z)


# ---- greedy choices ------------------------------------------------------------------------------------------


def greedy(rows: DataFrame, by: Sequence[str], order: Sequence[str], schema: str, values: Sequence[str], chosen: Callable[[np.ndarray, np.ndarray], bool]) -> DataFrame:
    """The rows that ``chosen(last kept values, own values)`` keeps; the first of a session always. In order, in sorted batches.

    Each choice depends on the one before, so a session is one task; memory holds one batch.
    """
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, None
        for b in batches:
            keys = list(zip(*(b[c] for c in by), strict=True))
            data = b[list(values)].to_numpy(dtype=float)
            keep = np.zeros(len(b), dtype=bool)
            for i, k in enumerate(keys):
                if k != key or chosen(last, data[i]):
                    key, last, keep[i] = k, data[i], True
            yield b.loc[keep, columns]

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(run, schema)


def keyframe_rule(distance: float = 0.5, degrees: float = 10.0, seconds: float = 2.0, second: float = 1e6) -> Callable[[np.ndarray, np.ndarray], bool]:
    """values: t, px, py, pz, qx, qy, qz, qw."""

    def chosen(last: np.ndarray, now: np.ndarray) -> bool:
        turn = 2 * np.degrees(np.arccos(min(1.0, abs(float(last[4:] @ now[4:])))))
        return bool(np.linalg.norm(now[1:4] - last[1:4]) >= distance or turn >= degrees or now[0] - last[0] >= seconds * second)

    return chosen


def stride_rule(stride: float) -> Callable[[np.ndarray, np.ndarray], bool]:
    """values: places."""
    return lambda last, now: bool(np.linalg.norm(now - last) >= stride)


# ---- trailing windows ----------------------------------------------------------------------------------------


def trailing(by: str, t: str, width: int) -> Window:
    return Window.partitionBy(by).orderBy(t).rangeBetween(-width, 0)


def smoothed(rows: DataFrame, by: str, order: Sequence[str], value: str, weight: float, block: int) -> DataFrame:
    """rows with ``smooth``: exponential smoothing. A block's rows fold in their own row; what comes in from the block before it has the weight left.

    rows need ``n``, their place in the session from 0. Blocks before a block act through one number each, so the recursion runs over blocks.
    """
    at = rows.withColumn("_b", F.floor(F.col("n") / block)).withColumn("_k", F.col("n") % block)
    lists = at.groupBy(by, "_b").agg(F.sort_array(F.collect_list(F.struct("_k", F.col(value).cast("double").alias("v")))).alias("_l"))
    fold = F.aggregate("_l", F.array().cast("array<double>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)) * (1 - weight), F.lit(0.0)) + weight * x["v"])))
    folded = lists.select(by, "_b", fold.alias("_f"), F.size("_l").alias("_n"), F.col("_l")[0]["v"].alias("_first"))
    chain = folded.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("_b", F.element_at("_f", -1).alias("e"), "_n", "_first"))).alias("_c"))
    state = "array<struct<_b: bigint, carry: double>>"
    # the first row starts the filter at its own value
    carried = F.aggregate(
        "_c", F.array(F.struct(F.lit(0).cast("long").alias("_b"), F.col("_c")[0]["_first"].alias("carry"))).cast(state),
        lambda out, c: F.concat(out, F.array(F.struct((c["_b"] + 1).cast("long").alias("_b"), (c["e"] + F.element_at(out, -1)["carry"] * F.pow(F.lit(1 - weight), c["_n"])).alias("carry")))).cast(state),
    )
    carries = chain.select(by, F.explode(carried).alias("c")).select(by, "c._b", "c.carry")
    joined = at.join(folded.select(by, "_b", "_f"), [by, "_b"]).join(carries, [by, "_b"])
    own = F.element_at("_f", (F.col("_k") + 1).cast("int")) + F.col("carry") * F.pow(F.lit(1 - weight), F.col("_k") + 1)
    return joined.withColumn("smooth", own).drop("_b", "_k", "_f", "carry")


def densified(probes: DataFrame, knots: DataFrame, gyro: DataFrame, by: str, bucket: int, max_gap: int, longest: int, second: float = 1e6) -> DataFrame:
    """posed() rows whose attitude follows the gyro across the bracket, and ``how``: gyro, or why it is the plain arc.

    The error that is left at the bracket's far end is spread over the bracket in proportion to time. Brackets beyond
    ``longest``, hits of a knot, and stretches the gyro doesn't cover or leaves a hole in, keep the arc.
    """
    rows = posed(probes, knots, by, bucket).withColumn("_row", F.monotonically_increasing_id())
    fits = rows.where("before is not null and after is not null and after.t > before.t").where(F.col("after.t") - F.col("before.t") <= longest)
    bridge = lambda end, name: gyro_bridge(fits.select(by, "_row", F.col("before.t").alias("t0"), end.alias("t1")), gyro, by, max_gap, bucket, second).select(
        "_row", F.struct(*Q, "hole", "covered").alias(name)
    )
    both = bridge(F.col("t"), "_near").join(bridge(F.col("after.t"), "_far"), "_row")
    at = rows.join(both, "_row", "left")
    first, last = quaternion("before."), quaternion("after.")
    q = lambda n: tuple(F.col(f"{n}.{c}") for c in Q)
    # what turns the gyro's end into the knot's; in steps, so that no expression is written out inside the next
    rest = geometry.multiplied(geometry.conjugate(tuple(F.col(f"_e{c}") for c in Q)), last)  # type: ignore[arg-type]
    at = at.withColumns({f"_e{c}": m for c, m in zip(Q, geometry.multiplied(first, q("_far")), strict=True)})  # type: ignore[arg-type]
    at = at.withColumns({f"_r{c}": m for c, m in zip(Q, rest, strict=True)})
    zero = F.lit(0.0)
    spread = geometry.slerp((zero, zero, zero, F.lit(1.0)), quaternion("_r"), asof.fraction())
    at = at.withColumns({f"_s{c}": m for c, m in zip(Q, spread, strict=True)} | {f"_n{c}": m for c, m in zip(Q, geometry.multiplied(first, q("_near")), strict=True)})  # type: ignore[arg-type]
    at = at.withColumns({f"_m{c}": m for c, m in zip(Q, geometry.multiplied(quaternion("_n"), quaternion("_s")), strict=True)})
    made = geometry.normalised(quaternion("_m"))
    how = (
        F.when(F.col("px").isNull(), "no_pose")
        .when(F.col("before.t") == F.col("after.t"), "knot")
        .when(F.col("_far").isNull(), "too_long")
        .when(~F.col("_far.covered") | ~F.col("_near.covered"), "not_covered")
        .when(F.col("_far.hole"), "hole")
        .otherwise("gyro")
    )
    at = at.withColumn("how", how)
    return at.withColumns({c: F.when(F.col("how") == "gyro", m).otherwise(F.col(c)) for c, m in zip(Q, made, strict=True)}).drop("_near", "_far", "_row", *[f"_{k}{c}" for k in "ersnm" for c in Q])


def blended(probes: DataFrame, corrections: DataFrame, by: str, bucket: int) -> DataFrame:
    """probes (by, t, px..pz, qx..qw, ...) under the corrections of the keyframes around them, mixed by time; beyond the ends the nearest holds.

    corrections: (by, t, cx..cz, ex..ew), shifts and turns in the world.
    """
    names = ["cx", "cy", "cz", "ex", "ey", "ez", "ew"]
    at = asof.brackets(probes, corrections, by, names, bucket)
    at = at.withColumns({"before": F.coalesce("before", "after"), "after": F.coalesce("after", "before")})

    def under(side: str) -> tuple[list[Column], geometry.Quaternion]:
        e = tuple(F.col(f"{side}.{c}") for c in names[3:])
        turned = geometry.rotated(e, *[F.col(c) for c in P])  # type: ignore[arg-type]
        return [t + F.col(f"{side}.{c}") for t, c in zip(turned, names, strict=False)], geometry.multiplied(e, quaternion())  # type: ignore[arg-type]

    u = F.least(F.lit(1.0), F.greatest(F.lit(0.0), asof.fraction()))
    (pa, qa), (pb, qb) = under("before"), under("after")
    at = at.withColumns({f"_{k}{n}": c for k, p, q in (("a", pa, qa), ("b", pb, qb)) for n, c in zip((*P, *Q), (*p, *q), strict=True)} | {"_u": u})
    arc = geometry.slerp(quaternion("_a"), quaternion("_b"), F.col("_u"))
    mixed = [F.col(f"_a{c}") + (F.col(f"_b{c}") - F.col(f"_a{c}")) * F.col("_u") for c in P]
    return at.withColumns(dict(zip((*P, *Q), (*mixed, *arc), strict=True))).drop("before", "after", "_u", *[f"_{k}{c}" for k in "ab" for c in (*P, *Q)])


def mean_attitude(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """The mean attitude of each group (qx..qw of rows), signs brought to that of the largest w first; and the spread about it in degrees."""
    signed = rows.withColumn("_s", F.when(F.col("qw") < 0, -1.0).otherwise(1.0))
    sums = signed.groupBy(*by).agg(*[F.sum(F.col(c) * F.col("_s")).alias(c) for c in Q], F.count("*").alias("n"))
    mean = sums.select(*by, "n", *[c.alias(n) for n, c in zip(Q, geometry.normalised(quaternion()), strict=True)])
    off = rows.select(*by, *[F.col(c).alias(f"r{c}") for c in Q]).join(mean.select(*by, *Q), list(by))
    turn = geometry.turn_degrees(quaternion(), quaternion("r"))
    return mean.join(off.groupBy(*by).agg(F.sqrt(F.avg(turn * turn)).alias("spread")), list(by))


#: How far from flat a device must be for its way up to mean something, and half a quadrant, in degrees.
LEAST_TILT, HALF_QUADRANT = 20.0, 45.0


def hold_of(q: geometry.Quaternion, sensor_degrees: Column | float = 90.0) -> Column:
    """How a device is held at an attitude of its rear camera, as a struct of orientation, angle, pitch, tilt and confident.

    The world's up (y) is turned into the camera's frame and, by the camera's mounting (90 degrees where it is null), into the
    device's. angle is its bearing in the screen's plane, 0 where the screen's own up is; pitch how far the screen leans back; tilt
    how far it is from flat. The bearing's quadrant is the orientation; a device too flat to be sure counts as portrait.
    """
    half = F.radians(F.coalesce(F.lit(sensor_degrees) if isinstance(sensor_degrees, float) else sensor_degrees.cast("double"), F.lit(90.0))) / 2
    given = F.struct(*[c.alias(k) for c, k in zip(q, Q, strict=True)], F.sin(half).alias("mz"), F.cos(half).alias("mw"))
    vector = lambda v: F.struct(*[c.alias(k) for c, k in zip(v, "xyz", strict=True)])

    # each turn is one value for the next: written out inside each other they fill 390,000 characters
    def turned(g: Column) -> Column:
        camera = geometry.rotated(geometry.conjugate(tuple(g[c] for c in Q)), F.lit(0.0), F.lit(1.0), F.lit(0.0))  # type: ignore[arg-type]
        return geometry.let(vector(camera), lambda v: vector(geometry.rotated((F.lit(0.0), F.lit(0.0), -g["mz"], g["mw"]), v["x"], v["y"], v["z"])))

    def read(u: Column) -> Column:
        flat = F.sqrt(u["x"] * u["x"] + u["y"] * u["y"])
        angle, sure = F.degrees(F.atan2(u["x"], u["y"])), flat >= F.sin(F.radians(F.lit(LEAST_TILT)))
        way = (
            F.when(~sure | ((angle >= -HALF_QUADRANT) & (angle < HALF_QUADRANT)), "portrait")
            .when((angle >= HALF_QUADRANT) & (angle < 180 - HALF_QUADRANT), "landscape_left")
            .when((angle >= HALF_QUADRANT - 180) & (angle < -HALF_QUADRANT), "landscape_right")
            .otherwise("portrait_reverse")
        )
        return F.struct(way.alias("orientation"), angle.alias("angle"), F.degrees(F.atan2(u["z"], flat)).alias("pitch"), F.degrees(F.atan2(flat, F.abs(u["z"]))).alias("tilt"), sure.alias("confident"))

    return geometry.let(geometry.let(given, turned), read)
