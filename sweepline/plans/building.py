"""Registered queries on walls, openings and rooms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sweepline.operators import building, probes
from sweepline.plans.queries import query, r
from sweepline.session import table

#: A corridor and two rooms: each face from x0, y0 to x1, y1; the two with doors are crossed by gaps of 90 cm.
FACES = ((0, 0, 8, 0), (8, 0, 8, 5), (8, 5, 0, 5), (0, 5, 0, 0), (0, 1.4, 8, 1.4), (0, 1.55, 8, 1.55), (3.85, 1.55, 3.85, 5), (4, 1.55, 4, 5))
DOORS = ((1.5, 2.4), (5.5, 6.4))


def occupied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as returns from the faces of one building in each status, as occupied cells of 2 cm."""
    t = table(spark, sf_dir, "lineitem")
    faces = F.array(*[F.struct(*[F.lit(float(v)).alias(k) for v, k in zip(f, ("x0", "y0", "x1", "y1"), strict=True)]) for f in FACES])
    k = (F.col("l_orderkey") % len(FACES)).cast("int")
    rows = t.select(F.col("l_linestatus").alias("plan"), faces[k].alias("f"), k.alias("k"), "l_partkey", "l_suppkey", "l_discount", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("n"))
    s = F.pmod(F.col("l_partkey") * 0.6180339887 + F.col("l_suppkey") * 0.4142135623 + F.col("n") / 8.0, F.lit(1.0))
    thick = (F.col("l_discount") - 0.05) / 8
    dx, dy = F.col("f.x1") - F.col("f.x0"), F.col("f.y1") - F.col("f.y0")
    flat = dy == 0
    at = rows.select("plan", "k", (F.col("f.x0") + s * dx + F.when(flat, 0.0).otherwise(thick)).alias("x"), (F.col("f.y0") + s * dy + F.when(flat, thick).otherwise(0.0)).alias("y"))
    gap = F.lit(False)
    for low, high in DOORS:
        gap = gap | F.col("x").between(low, high)
    cell = lambda c: (F.floor(F.col(c) / 0.02) * 0.02 + 0.01).alias(c)
    return at.where(~(F.col("k").isin(4, 5) & gap)).select("plan", cell("x"), cell("y")).distinct()


@query()
def walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walls of each building; the search is seeded, so tests compare them with the building's measures."""
    found, _ = building.extract_walls(occupied(spark, sf_dir), "plan")
    return found.select("plan", "wall", *[r(c, 4).alias(c) for c in ("ax", "ay", "bx", "by_", "thickness", "coverage", "confidence")], "paired", "support")


@query()
def plan_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = building.extract_walls(occupied(spark, sf_dir), "plan")
    return found.select("plan", "wall", "kind", r("width", 4).alias("width"))


@query()
def rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = building.extract_walls(occupied(spark, sf_dir), "plan")
    return building.rooms(found, "plan").select("plan", "room", *[r(c, 4).alias(c) for c in ("area", "perimeter", "cx", "cy", "confidence")], "measured")


LINES = """l as (select c_nationkey plan, c_custkey line, c_acctbal / 1000 px, (c_custkey % 13) * 0.02::double py, c_custkey % 7 * 0.02::double + case when c_custkey % 3 = 0 then pi() / 2 else 0 end th, 0.3 + c_custkey % 5 / 2::double total from customer)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as lines of a plan for each nation."""
    k = F.col("c_custkey")
    th = k % 7 * 0.02 + F.when(k % 3 == 0, F.lit(3.141592653589793) / 2).otherwise(0.0)
    return table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("plan"), k.alias("line"), (F.col("c_acctbal") / 1000).alias("px"), (k % 13 * 0.02).alias("py"), F.cos(th).alias("dx"), F.sin(th).alias("dy"), (0.3 + k % 5 / 2.0).alias("total")
    )


@query(f"""with {LINES}, d as (select *, cos(th) dx, sin(th) dy, atan2(sin(th), cos(th)) h from l)
 select a.plan, a.line a, b.line b from d a join d b on a.plan = b.plan and a.line < b.line where abs(a.h - b.h - pi() * round((a.h - b.h) / pi())) <= radians(4) and abs(a.dx * (b.py - a.py) - a.dy * (b.px - a.px)) <= 0.05 and abs(b.dx * (b.py - a.py) - b.dy * (b.px - a.px)) <= 0.05""")
def collinear_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return building.collinear(lines(spark, sf_dir), "plan")


@query(f"""with {LINES}, s as (select plan, sum(case when total >= 0.8 then total end * cos(4 * atan2(sin(th), cos(th)))) c, sum(case when total >= 0.8 then total end * sin(4 * atan2(sin(th), cos(th)))) s, sum(total * cos(4 * atan2(sin(th), cos(th)))) c0, sum(total * sin(4 * atan2(sin(th), cos(th)))) s0 from l group by plan),
 a as (select plan, atan2(coalesce(s, s0), coalesce(c, c0)) / 4 a from s) select plan, round(a - pi() / 2 * floor(a / (pi() / 2)), 8) theta0 from a""")
def dominant_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main direction of each plan, right angles apart being one."""
    return building.dominant_angle(lines(spark, sf_dir), "plan").select("plan", r("theta0", 8).alias("theta0"))


@query("""with l as (select l_suppkey wall, l_quantity lo, l_quantity + 0.5 + l_discount * 10 hi from lineitem), b as (select *, max(hi) over (partition by wall order by lo, hi rows between unbounded preceding and 1 preceding) m from l),
 g as (select *, count(*) filter (m is null or lo - m > 0.15) over (partition by wall order by lo, hi rows unbounded preceding) g from b) select wall, round(min(lo), 6) lo, round(max(hi), 6) hi from g group by wall, g""")
def wall_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of wall, put together over gaps of up to 15 cm."""
    t = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("wall"), F.col("l_quantity").alias("lo"), (F.col("l_quantity") + 0.5 + F.col("l_discount") * 10).alias("hi"))
    m = building.merged_intervals(t, ["wall"], 0.15)
    return m.select("wall", r("lo", 6).alias("lo"), r("hi", 6).alias("hi"))


BAND = """p as (select l_linestatus plan, case when l_linenumber <= 3 then l_orderkey % 499 / 100::double else 2.5 + (l_quantity - 25.5) / 1000 end u, case when l_linenumber <= 3 then 1 + (l_quantity - 25.5) / 1000 else l_orderkey % 499 / 100::double end v from lineitem)"""
#: Parts of a room's height band; cells hold fewer points here than scans have.
PROBES = probes.Probes(least_cell=20, least=100, elongation=20.0)


def band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as two walls of 5 m that cross, 5 cm thick, in each status."""
    first, along, across = F.col("l_linenumber") <= 3, F.col("l_orderkey") % 499 / 100.0, (F.col("l_quantity") - 25.5) / 1000
    return table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("plan"), F.when(first, along).otherwise(2.5 + across).alias("u"), F.when(first, 1 + across).otherwise(along).alias("v"))


@query(f"""with {BAND}, s as (select plan, min(u) - 1.0::double u0, min(v) - 1.0::double v0 from p group by plan), c as (select plan, floor((u - u0) / 0.1::double)::bigint i, floor((v - v0) / 0.1::double)::bigint j, count(*) filled, any_value(u0) u0, any_value(v0) v0 from p join s using (plan) group by 1, 2, 3 having count(*) >= 20),
 d as (select c.plan, i, j, filled, u - (u0 + (i + 0.5::double) * 0.1::double) du, v - (v0 + (j + 0.5::double) * 0.1::double) dv from c join p using (plan) where du * du + dv * dv <= 0.25),
 m as (select plan, i, j, filled, count(*) n, covar_pop(du, du) uu, covar_pop(du, dv) uv, covar_pop(dv, dv) vv from d group by all having count(*) >= 100), e as (select *, (uu + vv) / 2 - sqrt(((uu - vv) / 2) ** 2 + uv * uv) l2, (uu + vv) / 2 + sqrt(((uu - vv) / 2) ** 2 + uv * uv) l1 from m)
 select plan, i, j, filled, n, round(sqrt(l2), 8) sigma from e where l2 > 0 and l1 >= 20 * l2""")
def probe_thickness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How thick each stretch of wall is, around every well-filled cell."""
    return probes.thickness(band(spark, sf_dir), "plan", PROBES).select("plan", "i", "j", "filled", "n", r("sigma", 8).alias("sigma"))


@query()
def wall_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve fullest stretches that keep apart; tests compare the choice with a loop over cells."""
    found = probes.wall_probes(band(spark, sf_dir), "plan", 12, PROBES)
    return found.select("plan", "place", "i", "j", "filled", r("sigma", 8).alias("sigma"))
