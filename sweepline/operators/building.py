"""Walls, openings and rooms from the occupied cells of floor plans, all plans at once.

The search for lines takes and removes one line after the other, so a plan's cells (bounded by its area) are one group there. All
that follows is joins and aggregates over lines, walls and half-edges, with a plan as part of every key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import pi

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sweepline.operators import graph
from sweepline.session import checkpointed


@dataclass(frozen=True)
class Walls:
    #: Fixed values, in metres and degrees.
    res: float = 0.02
    inlier: float = 0.035
    hypotheses: int = 600
    most_lines: int = 256
    least_apart: float = 0.40
    least_length: float = 0.60
    run_gap: float = 0.10
    least_run: float = 0.12
    collinear_offset: float = 0.05
    collinear_angle: float = 4.0
    dominant_length: float = 0.80
    snap: float = 7.0
    thin: float = 0.06
    thick: float = 0.40
    pair_angle: float = 3.0
    pair_overlap: float = 0.45
    one_face: float = 0.10
    corner: float = 0.45
    corner_angle: float = 20.0
    weld: float = 0.03
    least_gap: float = 0.15
    most_bridge: float = 2.0
    door: tuple[float, float] = (0.60, 1.20)
    seed: int = 7


@dataclass(frozen=True)
class Rooms:
    #: Fixed values.
    weld: float = 0.02
    least_area: float = 1.0
    inset: bool = True
    covered: float = 0.85


def folded(angle: Column, period: float) -> Column:
    """angle less whole periods, between minus and plus half a period."""
    return angle - period * F.round(angle / period)


def _cross(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - ay * bx


# ---- lines -----------------------------------------------------------------------------------------------------


def lines_of(cells: DataFrame, by: str, p: Walls = Walls()) -> DataFrame:
    """by, line, x, y: the cells of each line, found one after the other; a line's cells are out of the search for the next.

    A hypothesis is a line through two seeded cells; that with most cells within ``p.inlier`` is refitted twice. Cells are taken in
    the order of their places, so the lines are the same for any partitions.
    """
    least = max(12, int(p.least_length / p.res))

    def near(c: np.ndarray, at: np.ndarray, d: np.ndarray) -> np.ndarray:
        return np.abs(d[0] * (c[:, 1] - at[1]) - d[1] * (c[:, 0] - at[0])) <= p.inlier

    def search(group: pd.DataFrame) -> pd.DataFrame:
        left = group[["x", "y"]].drop_duplicates().sort_values(["x", "y"]).to_numpy()
        random, found = np.random.default_rng(p.seed), []
        while len(found) < p.most_lines and len(left) >= least:
            pairs = random.integers(0, len(left), (p.hypotheses, 2))
            a, ab = left[pairs[:, 0]], left[pairs[:, 1]] - left[pairs[:, 0]]
            length = np.hypot(ab[:, 0], ab[:, 1])
            far = length >= p.least_apart
            a, d = a[far], ab[far] / length[far, None]
            if not len(a):
                break
            counts = np.concatenate([
                (np.abs(d[k : k + 32, :1] * (left[:, 1] - a[k : k + 32, 1:]) - d[k : k + 32, 1:] * (left[:, 0] - a[k : k + 32, :1])) <= p.inlier).sum(axis=1) for k in range(0, len(a), 32)
            ])
            at, to = a[counts.argmax()], d[counts.argmax()]
            for _ in range(2):
                mine = left[near(left, at, to)]
                c = np.cov(mine.T, bias=True) if len(mine) > 1 else np.eye(2)
                theta = 0.5 * np.arctan2(2 * c[0, 1], c[0, 0] - c[1, 1])
                at, to = mine.mean(axis=0), np.array([np.cos(theta), np.sin(theta)])
            mine = near(left, at, to)
            if mine.sum() < least:
                break
            found.append(left[mine])
            left = left[~mine]
        out = pd.DataFrame(np.concatenate(found) if found else np.zeros((0, 2)), columns=["x", "y"])
        out.insert(0, "line", np.repeat(np.arange(len(found)), [len(f) for f in found]))
        out.insert(0, by, group[by].iloc[0])
        return out

    kind = cells.schema[by].dataType.simpleString()
    return cells.select(by, "x", "y").groupBy(by).applyInPandas(search, f"{by} {kind}, line long, x double, y double")


def fitted(cells: DataFrame, by: str, angle: DataFrame | None = None) -> DataFrame:
    """by, line, n, px, py, dx, dy, rms: the line through the centre of each line's cells along their principal axis, or at ``angle`` (by, line, theta)."""
    f = cells.groupBy(by, "line").agg(
        F.count("*").alias("n"), F.avg("x").alias("px"), F.avg("y").alias("py"), F.covar_pop("x", "x").alias("_xx"), F.covar_pop("x", "y").alias("_xy"), F.covar_pop("y", "y").alias("_yy")
    )
    own = 0.5 * F.atan2(2 * F.col("_xy"), F.col("_xx") - F.col("_yy"))
    f = f.withColumn("theta", own) if angle is None else f.join(angle, [by, "line"])
    f = f.withColumns({"dx": F.cos("theta"), "dy": F.sin("theta")})
    across = F.col("dy") * F.col("dy") * F.col("_xx") - 2 * F.col("dx") * F.col("dy") * F.col("_xy") + F.col("dx") * F.col("dx") * F.col("_yy")
    return f.select(by, "line", "n", "px", "py", "dx", "dy", F.sqrt(F.greatest(F.lit(0.0), across)).alias("rms"))


def runs_of(cells: DataFrame, lines: DataFrame, by: str, p: Walls) -> DataFrame:
    """by, line, lo, hi: where along each line its cells are, in stretches with gaps up to ``p.run_gap``, half a cell longer at each end."""
    t = (F.col("x") - F.col("px")) * F.col("dx") + (F.col("y") - F.col("py")) * F.col("dy")
    at = cells.join(lines.select(by, "line", "px", "py", "dx", "dy"), [by, "line"]).select(by, "line", t.alias("t"))
    along = Window.partitionBy(by, "line").orderBy("t")
    at = at.withColumn("_b", (F.col("t") - F.lag("t").over(along) > p.run_gap).cast("int"))
    at = at.withColumn("_r", F.sum(F.coalesce("_b", F.lit(0))).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    runs = at.groupBy(by, "line", "_r").agg((F.min("t") - p.res / 2).alias("lo"), (F.max("t") + p.res / 2).alias("hi"))
    return runs.where(F.col("hi") - F.col("lo") >= p.least_run).drop("_r")


def _long_enough(cells: DataFrame, lines: DataFrame, by: str, p: Walls) -> tuple[DataFrame, DataFrame]:
    """Lines with their total run, and their runs, where the total is a wall's."""
    runs = checkpointed(runs_of(cells, lines, by, p))
    total = runs.groupBy(by, "line").agg(F.sum(F.col("hi") - F.col("lo")).alias("total")).where(F.col("total") >= p.least_length)
    lines = checkpointed(lines.join(total, [by, "line"]))
    return lines, runs.join(lines.select(by, "line"), [by, "line"], "left_semi")


def collinear(lines: DataFrame, by: str, p: Walls = Walls()) -> DataFrame:
    """by, a, b: pairs of lines that agree in heading and, each seen from the other, in offset."""
    # headings are taken once a line, and offsets are asked first: both ends of a pair are many
    own = lines.select(by, "line", "px", "py", "dx", "dy", F.atan2("dy", "dx").alias("h"))
    a, b = own.alias("a"), own.alias("b")
    turn = F.col("a.h") - F.col("b.h")
    turn = turn - pi * F.rint(turn / pi)
    gap = lambda o: F.abs(_cross(F.col(f"{o}.dx"), F.col(f"{o}.dy"), F.col("b.px") - F.col("a.px"), F.col("b.py") - F.col("a.py")))
    near = (gap("a") <= p.collinear_offset) & (gap("b") <= p.collinear_offset) & (F.abs(turn) <= np.radians(p.collinear_angle))
    return a.join(b.hint("merge"), (F.col(f"a.{by}") == F.col(f"b.{by}")) & (F.col("a.line") < F.col("b.line")) & near).select(f"a.{by}", F.col("a.line").alias("a"), F.col("b.line").alias("b"))


def dominant_angle(lines: DataFrame, by: str, p: Walls = Walls()) -> DataFrame:
    """by, theta0 from 0 to a right angle: the circular mean of four times the headings, weighted by length; short lines vote where there are no others."""
    four = 4 * F.atan2("dy", "dx")
    long_ = F.when(F.col("total") >= p.dominant_length, F.col("total")).otherwise(0.0)
    sums = lines.groupBy(by).agg(
        *[F.sum(w * f(four)).alias(n) for n, w, f in (("_c", long_, F.cos), ("_s", long_, F.sin), ("_c0", F.col("total"), F.cos), ("_s0", F.col("total"), F.sin))], F.sum(long_).alias("_n")
    )
    c, s = (F.when(F.col("_n") > 0, F.col(k)).otherwise(F.col(f"{k}0")) for k in ("_c", "_s"))
    return sums.select(by, F.pmod(F.atan2(s, c) / 4, F.lit(pi / 2)).alias("theta0"))


def straightened(found: DataFrame, by: str, p: Walls = Walls()) -> tuple[DataFrame, DataFrame]:
    """Lines (by, line, n, px, py, dx, dy, rms, total, snapped) and their runs: collinear ones merged, those near the dominant directions turned to them."""
    found = checkpointed(found)
    lines, _ = _long_enough(found, fitted(found, by), by, p)
    merged = graph.components(lines.select(by, F.col("line").alias("node")), collinear(lines, by, p), by)
    cells = found.join(merged.withColumnRenamed("node", "line"), [by, "line"]).select(by, F.col("label").alias("line"), "x", "y")
    cells = checkpointed(cells)
    lines, _ = _long_enough(cells, fitted(cells, by), by, p)
    theta = F.atan2("dy", "dx")
    off = folded(theta - F.col("theta0"), pi / 2)
    angles = lines.join(dominant_angle(lines, by, p), by).withColumn("snapped", F.abs(off) <= np.radians(p.snap))
    angles = checkpointed(angles.select(by, "line", "snapped", F.when(F.col("snapped"), theta - off).otherwise(theta).alias("theta")))
    cells = cells.join(angles.select(by, "line"), [by, "line"], "left_semi")
    runs = checkpointed(runs_of(cells, turned := checkpointed(fitted(cells, by, angles.drop("snapped"))), by, p))
    total = runs.groupBy(by, "line").agg(F.sum(F.col("hi") - F.col("lo")).alias("total"))
    return turned.join(total, [by, "line"]).join(angles.drop("theta"), [by, "line"]), runs


# ---- walls -----------------------------------------------------------------------------------------------------


def merged_intervals(intervals: DataFrame, by: Sequence[str], gap: float) -> DataFrame:
    """by, lo, hi: intervals put together where they overlap or lie at most ``gap`` apart."""
    along = Window.partitionBy(*by).orderBy("lo", "hi")
    reach = F.max("hi").over(along.rowsBetween(Window.unboundedPreceding, -1))
    at = intervals.select(*by, "lo", "hi").withColumn("_b", F.coalesce((F.col("lo") - reach > gap).cast("int"), F.lit(1)))
    at = at.withColumn("_g", F.sum("_b").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return at.groupBy(*by, "_g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_g")


def _moved(runs: DataFrame, pairs: DataFrame, by: str, line: str) -> DataFrame:
    """Runs of ``line`` of each pair (by, i, j, flip, shift) along the pair's first line."""
    r = runs.join(pairs.select(by, "i", "j", "flip", "shift"), [*[by], line]) if line in runs.columns else runs
    lo, hi = F.when(F.col("flip"), -F.col("hi")).otherwise(F.col("lo")), F.when(F.col("flip"), -F.col("lo")).otherwise(F.col("hi"))
    return r.select(by, "i", "j", (lo + F.col("shift")).alias("lo"), (hi + F.col("shift")).alias("hi"))


def face_pairs(lines: DataFrame, runs: DataFrame, by: str, p: Walls = Walls()) -> DataFrame:
    """by, i, j, off, overlap, flip, shift: lines that can be the two faces of one wall, by angle, distance and common length."""
    a, b = lines.alias("a"), lines.alias("b")
    turn = folded(F.atan2("a.dy", "a.dx") - F.atan2("b.dy", "b.dx"), pi)
    sx, sy = F.col("b.px") - F.col("a.px"), F.col("b.py") - F.col("a.py")
    off = _cross(F.col("a.dx"), F.col("a.dy"), sx, sy)
    fits = (F.abs(turn) <= np.radians(p.pair_angle)) & F.abs(off).between(p.thin, p.thick)
    pairs = a.join(b, (F.col(f"a.{by}") == F.col(f"b.{by}")) & (F.col("a.line") < F.col("b.line")) & fits).select(
        f"a.{by}", F.col("a.line").alias("i"), F.col("b.line").alias("j"), off.alias("off"), F.least("a.total", "b.total").alias("_t"),
        (F.col("a.dx") * F.col("b.dx") + F.col("a.dy") * F.col("b.dy") < 0).alias("flip"), (sx * F.col("a.dx") + sy * F.col("a.dy")).alias("shift"),
    )
    pairs = checkpointed(pairs)
    one = pairs.join(runs.withColumnRenamed("line", "i"), [by, "i"]).select(by, "i", "j", F.col("lo").alias("l0"), F.col("hi").alias("h0"))
    two = _moved(runs.withColumnRenamed("line", "j"), pairs, by, "j")
    common = one.join(two, [by, "i", "j"]).groupBy(by, "i", "j").agg(F.sum(F.greatest(F.lit(0.0), F.least("h0", "hi") - F.greatest("l0", "lo"))).alias("overlap"))
    return pairs.join(common, [by, "i", "j"]).where((F.col("overlap") > 0) & (F.col("overlap") >= p.pair_overlap * F.col("_t"))).drop("_t")


def wall_lines(lines: DataFrame, runs: DataFrame, by: str, p: Walls = Walls()) -> tuple[DataFrame, DataFrame]:
    """Centre lines (by, line, px, py, dx, dy, thickness, paired, rms, support) and their intervals: two faces make one, a line inside a paired wall none."""
    taken = checkpointed(graph.greedy_matching(face_pairs(lines, runs, by, p), by, "overlap"))
    used = taken.select(by, F.explode(F.array("i", "j")).alias("line"))
    second = lines.select(by, F.col("line").alias("j"), F.col("rms").alias("_r"), F.col("n").alias("_n"))
    paired = taken.join(lines.withColumnRenamed("line", "i"), [by, "i"]).join(second, [by, "j"]).select(
        by, F.col("i").alias("line"), (F.col("px") - F.col("dy") * F.col("off") / 2).alias("px"), (F.col("py") + F.col("dx") * F.col("off") / 2).alias("py"), "dx", "dy",
        F.abs("off").alias("thickness"), F.lit(True).alias("paired"), ((F.col("rms") + F.col("_r")) / 2).alias("rms"), (F.col("n") + F.col("_n")).alias("support"),
    )
    paired = checkpointed(paired)
    both = runs.withColumnRenamed("line", "i").join(taken.select(by, "i"), [by, "i"]).select(by, F.col("i").alias("line"), "lo", "hi")
    both = both.unionByName(_moved(runs.withColumnRenamed("line", "j"), taken, by, "j").select(by, F.col("i").alias("line"), "lo", "hi"))
    intervals = checkpointed(merged_intervals(both, [by, "line"], 0.0))
    single = lines.join(used, [by, "line"], "left_anti")
    # a single line that runs inside a paired wall is the noise between its faces
    w, s = paired.alias("w"), single.alias("s")
    sx, sy = F.col("s.px") - F.col("w.px"), F.col("s.py") - F.col("w.py")
    turn = folded(F.atan2("w.dy", "w.dx") - F.atan2("s.dy", "s.dx"), pi)
    inside = (F.abs(turn) <= np.radians(p.pair_angle)) & (F.abs(_cross(F.col("w.dx"), F.col("w.dy"), sx, sy)) <= F.col("w.thickness") / 2)
    inner = w.join(s, (F.col(f"w.{by}") == F.col(f"s.{by}")) & inside).select(
        f"w.{by}", F.col("w.line").alias("i"), F.col("s.line").alias("j"), (F.col("w.dx") * F.col("s.dx") + F.col("w.dy") * F.col("s.dy") < 0).alias("flip"), (sx * F.col("w.dx") + sy * F.col("w.dy")).alias("shift"),
    )
    own = _moved(runs.withColumnRenamed("line", "j"), inner, by, "j")
    whole = intervals.select(by, F.col("line").alias("i"), F.col("lo").alias("l0"), F.col("hi").alias("h0"))
    shared = own.join(whole, [by, "i"]).groupBy(by, "i", "j").agg(F.sum(F.greatest(F.lit(0.0), F.least("h0", "hi") - F.greatest("l0", "lo"))).alias("o"))
    length = own.groupBy(by, "i", "j").agg(F.sum(F.col("hi") - F.col("lo")).alias("t"))
    gone = shared.join(length, [by, "i", "j"]).where("o > 0.5 * t").select(by, F.col("j").alias("line")).distinct()
    single = checkpointed(single.join(gone, [by, "line"], "left_anti"))
    alone = single.select(by, "line", "px", "py", "dx", "dy", F.lit(p.one_face).alias("thickness"), F.lit(False).alias("paired"), "rms", F.col("n").alias("support"))
    return paired.unionByName(alone), intervals.unionByName(runs.join(single.select(by, "line"), [by, "line"], "left_semi").select(by, "line", "lo", "hi"))


def segments(lines: DataFrame, intervals: DataFrame, by: str, p: Walls = Walls()) -> tuple[DataFrame, DataFrame]:
    """Walls (by, wall, ax, ay, bx, by_, thickness, paired, rms, coverage, support, confidence) and openings (by, wall, ax, ay, bx, by_, width, kind).

    A gap of up to ``p.most_bridge`` is an opening in one wall, by width a narrow gap, a door or a wide opening; a wider one ends it.
    """
    at = merged_intervals(intervals, [by, "line"], p.least_gap)
    along = Window.partitionBy(by, "line").orderBy("lo")
    at = at.withColumn("_p", F.lag("hi").over(along)).withColumn("_b", F.coalesce((F.col("lo") - F.col("_p") > p.most_bridge).cast("int"), F.lit(1)))
    at = checkpointed(at.withColumn("piece", F.sum("_b").over(along.rowsBetween(Window.unboundedPreceding, 0))))
    pieces = at.groupBy(by, "line", "piece").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum(F.col("hi") - F.col("lo")).alias("covered")).where(F.col("hi") - F.col("lo") >= p.least_length)
    pieces = pieces.withColumn("wall", F.row_number().over(Window.partitionBy(by).orderBy("line", "piece")).cast("long"))
    place = lambda t: ((F.col("px") + F.col("dx") * F.col(t)), (F.col("py") + F.col("dy") * F.col(t)))
    walls = pieces.join(lines, [by, "line"])
    (ax, ay), (bx, by_) = place("lo"), place("hi")
    length = F.col("hi") - F.col("lo")
    coverage = F.col("covered") / F.nullif(length, F.lit(0.0))
    sure = 0.40 * F.least(F.lit(1.0), coverage) + 0.35 * F.greatest(F.lit(0.0), 1 - F.col("rms") / p.inlier) + 0.25 * F.least(F.lit(1.0), F.col("support") / F.greatest(F.lit(1.0), length / p.res * 2))
    sure = F.least(F.lit(1.0), sure + F.when(F.col("paired"), 0.05).otherwise(0.0))
    out = walls.select(by, "wall", ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by_.alias("by_"), "thickness", "paired", "rms", coverage.alias("coverage"), "support", sure.alias("confidence"))
    gaps = at.where("_b = 0").join(walls.select(by, "line", "piece", "wall", "px", "py", "dx", "dy"), [by, "line", "piece"])
    width = F.col("lo") - F.col("_p")
    kind = F.when(width < p.door[0], "narrow gap").when(width <= p.door[1], "door").otherwise("wide opening")
    (ax, ay), (bx, by_) = place("_p"), place("lo")
    return checkpointed(out), checkpointed(gaps.select(by, "wall", ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by_.alias("by_"), width.alias("width"), kind.alias("kind")))


def ends_of(walls: DataFrame, by: str) -> DataFrame:
    """by, node (2 wall, 2 wall + 1), wall, x, y: both ends of each wall."""
    end = lambda k, x, y: F.struct((F.col("wall") * 2 + k).alias("node"), F.col(x).alias("x"), F.col(y).alias("y"))
    return walls.select(by, "wall", F.explode(F.array(end(0, "ax", "ay"), end(1, "bx", "by_"))).alias("e")).select(by, "wall", "e.*")


def welded(ends: DataFrame, by: str, tolerance: float) -> DataFrame:
    """by, node, vertex, x, y: ends that chains of steps up to ``tolerance`` join have one vertex, at their mean."""
    a, b = ends.alias("a"), ends.alias("b")
    d2 = (F.col("a.x") - F.col("b.x")) * (F.col("a.x") - F.col("b.x")) + (F.col("a.y") - F.col("b.y")) * (F.col("a.y") - F.col("b.y"))
    near = a.join(b, (F.col(f"a.{by}") == F.col(f"b.{by}")) & (F.col("a.node") < F.col("b.node")) & (d2 <= tolerance * tolerance))
    label = graph.components(ends.select(by, "node"), near.select(f"a.{by}", F.col("a.node").alias("a"), F.col("b.node").alias("b")), by)
    at = ends.join(label, [by, "node"])
    mean = at.groupBy(by, "label").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return at.select(by, "node", "label").join(mean, [by, "label"]).select(by, "node", F.col("label").alias("vertex"), "x", "y")


def _relaid(walls: DataFrame, ends: DataFrame, by: str) -> DataFrame:
    """walls with their ends at new places (by, node, x, y)."""
    for k, (x, y) in enumerate((("ax", "ay"), ("bx", "by_"))):
        new = ends.select(by, F.col("node").alias("_n"), F.col("x").alias("_x"), F.col("y").alias("_y"))
        at = walls.withColumn("_n", F.col("wall") * 2 + k).join(new, [by, "_n"], "left")
        walls = at.withColumns({x: F.coalesce("_x", x), y: F.coalesce("_y", y)}).select(walls.columns)
    return walls


def joined_corners(walls: DataFrame, by: str, p: Walls = Walls()) -> DataFrame:
    """walls whose ends went to the nearest crossing with another wall within ``p.corner``; ends that then lie together are welded."""
    size = F.sqrt((F.col("bx") - F.col("ax")) * (F.col("bx") - F.col("ax")) + (F.col("by_") - F.col("ay")) * (F.col("by_") - F.col("ay")))
    w = walls.select(by, "wall", "ax", "ay", "bx", "by_", F.nullif(size, F.lit(0.0)).alias("len")).withColumns({"ux": (F.col("bx") - F.col("ax")) / F.col("len"), "uy": (F.col("by_") - F.col("ay")) / F.col("len")})
    a, b = w.alias("a"), w.alias("b")
    den = _cross(F.col("a.ux"), F.col("a.uy"), F.col("b.ux"), F.col("b.uy"))
    turn = F.abs(folded(F.atan2("a.uy", "a.ux") - F.atan2("b.uy", "b.ux"), pi))
    met = a.join(b, (F.col(f"a.{by}") == F.col(f"b.{by}")) & (F.col("a.wall") != F.col("b.wall")) & (turn >= np.radians(p.corner_angle)) & (F.abs(den) >= 1e-9))
    t = _cross(F.col("b.ax") - F.col("a.ax"), F.col("b.ay") - F.col("a.ay"), F.col("b.ux"), F.col("b.uy")) / F.nullif(den, F.lit(0.0))
    met = met.select(f"a.{by}", "a.wall", F.col("b.wall").alias("other"), "a.len", t.alias("t"), (F.col("a.ax") + F.col("a.ux") * t).alias("x"), (F.col("a.ay") + F.col("a.uy") * t).alias("y"), "b.ax", "b.ay", "b.ux", "b.uy", F.col("b.len").alias("blen"))
    on = (F.col("x") - F.col("ax")) * F.col("ux") + (F.col("y") - F.col("ay")) * F.col("uy")
    met = met.where((on >= -p.corner) & (on <= F.col("blen") + p.corner))
    costs = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.abs("t").alias("c")), F.struct(F.lit(1).alias("k"), F.abs(F.col("t") - F.col("len")).alias("c"))))
    best = met.withColumn("e", costs).where(F.col("e.c") <= p.corner).groupBy(by, (F.col("wall") * 2 + F.col("e.k")).alias("node")).agg(F.min(F.struct("e.c", "other", "x", "y")).alias("m"))
    walls = checkpointed(_relaid(walls, best.select(by, "node", "m.x", "m.y"), by))
    return checkpointed(_relaid(walls, welded(ends_of(walls, by), by, p.weld), by))


def extract_walls(cells: DataFrame, by: str, p: Walls = Walls()) -> tuple[DataFrame, DataFrame]:
    """Walls and openings of the occupied cells (by, x, y) of each plan; see segments() for the columns.

    Openings are in places along the walls as they were before corners were joined. An empty table has none.
    """
    lines, runs = straightened(lines_of(cells, by, p), by, p)
    walls, openings = segments(*wall_lines(checkpointed(lines), runs, by, p), by, p)
    return joined_corners(walls, by, p), openings


# ---- rooms -----------------------------------------------------------------------------------------------------


def rooms(walls: DataFrame, by: str, p: Rooms = Rooms()) -> DataFrame:
    """by, room, area, perimeter, cx, cy, confidence, measured: the faces that walls enclose, in reading order.

    Walls are cut where another's end lies on them. Every cut wall is two half-edges; the one that follows is the next clockwise
    at its end, so faces inside run counter-clockwise. Edges of paired walls move in by half the thickness. Rooms are ordered by
    their centre in bands of 25 cm, bottom to top, then left to right, then by area.
    """
    vertex = checkpointed(welded(ends_of(walls, by), by, p.weld))
    at = lambda k, n: vertex.select(by, F.col("node").alias("_n"), F.col("vertex").alias(f"v{n}"), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}")).withColumn("_w", F.expr("_n div 2")).where(F.col("_n") % 2 == k).drop("_n").withColumnRenamed("_w", "wall")
    w = walls.join(at(0, 0), [by, "wall"]).join(at(1, 1), [by, "wall"])
    size = F.sqrt((F.col("x1") - F.col("x0")) * (F.col("x1") - F.col("x0")) + (F.col("y1") - F.col("y0")) * (F.col("y1") - F.col("y0")))
    w = w.withColumn("len", F.when(size >= 1e-6, size)).where("len is not null").withColumns({"ux": (F.col("x1") - F.col("x0")) / F.col("len"), "uy": (F.col("y1") - F.col("y0")) / F.col("len")})
    inset = F.when(F.col("paired"), F.col("thickness") / 2).otherwise(0.0) if p.inset else F.lit(0.0)
    w = checkpointed(w.select(by, "wall", "v0", "v1", "x0", "y0", "len", "ux", "uy", inset.alias("inset"), "confidence", "coverage"))
    places = vertex.select(by, "vertex", F.col("x").alias("vx"), F.col("y").alias("vy")).distinct()
    t = (F.col("vx") - F.col("x0")) * F.col("ux") + (F.col("vy") - F.col("y0")) * F.col("uy")
    off = F.abs(_cross(F.col("ux"), F.col("uy"), F.col("vx") - F.col("x0"), F.col("vy") - F.col("y0")))
    inner = (t > p.weld) & (t < F.col("len") - p.weld) & (off <= p.weld) & (F.col("vertex") != F.col("v0")) & (F.col("vertex") != F.col("v1"))
    cuts = w.join(places, by).where(inner).select(by, "wall", "vertex", t.alias("t"))
    cuts = cuts.unionByName(w.select(by, "wall", F.col("v0").alias("vertex"), F.lit(0.0).alias("t"))).unionByName(w.select(by, "wall", F.col("v1").alias("vertex"), F.col("len").alias("t")))
    along = Window.partitionBy(by, "wall").orderBy("t", "vertex")
    parts = cuts.select(by, "wall", "t", F.col("vertex").alias("u"), F.lead("vertex").over(along).alias("v"), F.lead("t").over(along).alias("t1")).where("v is not null and u <> v and t1 - t >= 1e-6")
    parts = checkpointed(parts.withColumn("e", F.row_number().over(Window.partitionBy(by).orderBy("wall", "t")).cast("long") * 2))
    half = parts.select(by, "wall", F.explode(F.array(F.struct(F.col("e").alias("node"), F.col("u").alias("o"), F.col("v").alias("d")), F.struct((F.col("e") + 1).alias("node"), F.col("v").alias("o"), F.col("u").alias("d")))).alias("h")).select(by, "wall", "h.*")
    end = lambda c, n: places.select(by, F.col("vertex").alias(c), F.col("vx").alias(f"{n}x"), F.col("vy").alias(f"{n}y"))
    half = half.join(end("o", "o"), [by, "o"]).join(end("d", "d"), [by, "d"]).join(w.select(by, "wall", "inset", "confidence", "coverage"), [by, "wall"])
    half = checkpointed(half)
    around = Window.partitionBy(by, "o").orderBy(F.atan2(F.col("dy") - F.col("oy"), F.col("dx") - F.col("ox")), "node")
    before = F.coalesce(F.lag("node").over(around), F.last("node").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    following = half.select(by, F.expr("node ^ 1").alias("node"), before.alias("next"))
    following = checkpointed(following)
    face = graph.cycles(following, by).withColumnRenamed("label", "face")
    h = half.join(following, [by, "node"]).join(face, [by, "node"])
    size = F.sqrt((F.col("dx") - F.col("ox")) * (F.col("dx") - F.col("ox")) + (F.col("dy") - F.col("oy")) * (F.col("dy") - F.col("oy")))
    h = h.withColumn("len", F.nullif(size, F.lit(0.0))).withColumns({"ux": (F.col("dx") - F.col("ox")) / F.col("len"), "uy": (F.col("dy") - F.col("oy")) / F.col("len")})
    h = h.withColumns({"lx": F.col("ox") - F.col("uy") * F.col("inset"), "ly": F.col("oy") + F.col("ux") * F.col("inset")})
    raw = h.groupBy(by, "face").agg((F.sum(_cross(F.col("ox"), F.col("oy"), F.col("dx"), F.col("dy"))) / 2).alias("_a"), F.count("*").alias("_k")).where((F.col("_k") >= 3) & (F.col("_a") > 0) & (F.col("_a") >= p.least_area / 4))
    h = checkpointed(h.join(raw.select(by, "face"), [by, "face"], "left_semi"))
    # the corner between an edge moved in and the one that follows
    g = h.select(by, F.col("node").alias("next"), *[F.col(c).alias(f"g_{c}") for c in ("ux", "uy", "lx", "ly")])
    den = _cross(F.col("ux"), F.col("uy"), F.col("g_ux"), F.col("g_uy"))
    t = _cross(F.col("g_lx") - F.col("lx"), F.col("g_ly") - F.col("ly"), F.col("g_ux"), F.col("g_uy")) / F.when(F.abs(den) >= 1e-9, den)
    corner = h.join(g, [by, "next"]).select(by, "face", "node", "next", "len", "confidence", "coverage", F.coalesce(F.col("lx") + F.col("ux") * t, F.col("g_lx")).alias("x"), F.coalesce(F.col("ly") + F.col("uy") * t, F.col("g_ly")).alias("y"))
    corner = checkpointed(corner)
    to = corner.select(by, F.col("node").alias("next"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    c = _cross(F.col("x"), F.col("y"), F.col("nx"), F.col("ny"))
    sums = corner.join(to, [by, "next"]).groupBy(by, "face").agg(
        (F.sum(c) / 2).alias("_a"), F.sum(F.sqrt((F.col("nx") - F.col("x")) * (F.col("nx") - F.col("x")) + (F.col("ny") - F.col("y")) * (F.col("ny") - F.col("y")))).alias("perimeter"),
        F.sum((F.col("x") + F.col("nx")) * c).alias("_x"), F.sum((F.col("y") + F.col("ny")) * c).alias("_y"),
        (F.sum(F.col("confidence") * F.col("len")) / F.sum("len")).alias("confidence"), F.min((F.col("coverage") >= p.covered).cast("int")).alias("_m"),
    )
    found = sums.where(F.abs("_a") >= p.least_area).select(by, F.abs("_a").alias("area"), "perimeter", (F.col("_x") / 6 / F.nullif("_a", F.lit(0.0))).alias("cx"), (F.col("_y") / 6 / F.nullif("_a", F.lit(0.0))).alias("cy"), "confidence", (F.col("_m") == 1).alias("measured"))
    band = lambda v: F.floor(F.col(v) / 0.25 + 0.5)
    order = Window.partitionBy(by).orderBy(band("cy"), band("cx"), "area", "cx")
    return found.select(by, F.concat(F.lit("R"), F.row_number().over(order).cast("string")).alias("room"), "area", "perimeter", "cx", "cy", "confidence", "measured")
