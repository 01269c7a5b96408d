"""Probes of wall thickness: the scatter across a wall around well-filled cells, and a choice of cells that keep apart."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sweepline.operators.spatial import eigenvalues_2d
from sweepline.session import checkpointed


@dataclass(frozen=True)
class Probes:
    #: Fixed values, in metres.
    cell: float = 0.1
    radius: float = 0.5
    least_cell: int = 40
    least: int = 200
    elongation: float = 20.0
    margin: float = 1.0


def thickness(points: DataFrame, by: str, p: Probes = Probes()) -> DataFrame:
    """by, i, j, u, v, filled, n, sigma: cells that are walls, with the deviation across the wall in the disc around their centre.

    points: by, u, v in a wall's height band. The lattice begins ``p.margin`` before the group's least u and v. Cells hold at least
    ``p.least_cell`` points; a disc has at least ``p.least``, and its larger variance is at least ``p.elongation`` of the smaller.
    Places are summed as offsets from the centre.
    """
    points = points.where("u is not null and v is not null and not isnan(u) and not isnan(v)")
    start = points.groupBy(by).agg(*[(F.min(c) - p.margin).alias(f"_{c}") for c in "uv"])
    cell = {n: F.floor((F.col(c) - F.col(f"_{c}")) / p.cell).cast("long") for n, c in zip("ij", "uv", strict=True)}
    at = points.join(start, by).withColumns(cell)
    full = at.groupBy(by, "i", "j").agg(F.count("*").alias("filled"), F.first("_u").alias("_u"), F.first("_v").alias("_v")).where(F.col("filled") >= p.least_cell)
    centres = full.select(by, "i", "j", "filled", *[(F.col(f"_{c}") + (F.col(n) + 0.5) * p.cell).alias(f"c{c}") for n, c in zip("ij", "uv", strict=True)])
    # blocks as wide as the radius: a disc lies in the nine around its centre
    block = lambda c: F.floor(F.col(c) / p.radius).cast("long")
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in product((-1, 0, 1), repeat=2)]))
    asked = centres.withColumn("s", around).select("*", (block("cu") + F.col("s.a")).alias("bu"), (block("cv") + F.col("s.b")).alias("bv")).drop("s")
    near = asked.join(at.select(by, "u", "v", block("u").alias("bu"), block("v").alias("bv")), [by, "bu", "bv"])
    du, dv = F.col("u") - F.col("cu"), F.col("v") - F.col("cv")
    near = near.where(du * du + dv * dv <= p.radius * p.radius)
    sums = near.groupBy(by, "i", "j", "filled", "cu", "cv").agg(F.count("*").alias("n"), F.covar_pop(du, du).alias("_uu"), F.covar_pop(du, dv).alias("_uv"), F.covar_pop(dv, dv).alias("_vv"))
    large, small = eigenvalues_2d(F.col("_uu"), F.col("_uv"), F.col("_vv"))
    sums = sums.where(F.col("n") >= p.least).withColumns({"_l": large, "_s": small}).where((F.col("_s") > 0) & (F.col("_l") >= p.elongation * F.col("_s")))
    return sums.select(by, "i", "j", F.col("cu").alias("u"), F.col("cv").alias("v"), "filled", "n", F.sqrt("_s").alias("sigma"))


def wall_probes(points: DataFrame, by: str, most: int, p: Probes = Probes()) -> DataFrame:
    """The first ``most`` of thickness() rows, with ``place``: the fullest cells first, then by i and j, each half a radius away from those before it.

    In each round every cell goes in that comes before all that are left around it, and its surroundings go out; this takes the same cells
    as going through them one by one.
    """
    apart = -int(-0.5 * p.radius // p.cell)
    order = F.struct((-F.col("filled")).alias("f"), "i", "j")
    left = checkpointed(thickness(points, by, p))
    taken = left.limit(0)
    steps = F.explode(F.sequence(F.lit(-apart), F.lit(apart)))
    while left.take(1):
        spread = left.select(by, order.alias("o"), "i", "j").withColumn("a", steps).withColumn("b", steps)
        best = spread.groupBy(by, (F.col("i") + F.col("a")).alias("i"), (F.col("j") + F.col("b")).alias("j")).agg(F.min("o").alias("o"))
        won = checkpointed(left.join(best, [by, "i", "j"]).where(order == F.col("o")).select(left.columns))
        gone = won.select(by, "i", "j").withColumn("a", steps).withColumn("b", steps).select(by, (F.col("i") + F.col("a")).alias("i"), (F.col("j") + F.col("b")).alias("j")).distinct()
        left, taken = checkpointed(left.join(gone, [by, "i", "j"], "left_anti").select(left.columns)), taken.unionByName(won)
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("filled"), "i", "j"))
    return taken.withColumn("place", place).where(F.col("place") <= most)
