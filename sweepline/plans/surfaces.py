"""Registered queries on planes, normals and a map's agreement with itself, each with its oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sweepline.operators import surfaces
from sweepline.plans.queries import query, r
from sweepline.session import table

SECOND = 1_000_000_000


def painted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a room of four walls, painted once in each of seven windows; each time the map has moved 1 cm along x."""
    t = table(spark, sf_dir, "lineitem")
    wall, u, n = F.col("l_suppkey") % 4, F.col("l_partkey") % 26 / 25.0 - 0.5, (F.col("l_quantity") - 25) / 5000.0
    moved = (F.col("l_linenumber") - 1) / 100.0
    return t.select(
        F.col("l_linestatus").alias("session"),
        ((F.col("l_linenumber") - 1) * F.lit(8 * SECOND) + F.col("l_suppkey") % 7 * SECOND).alias("t"),
        (F.when(wall == 0, 2.0 + n).when(wall == 1, -2.0 + n).otherwise(u) + moved).alias("x"),
        (F.col("l_orderkey") % 25 / 25.0).alias("y"),
        F.when(wall < 2, u).when(wall == 2, 1.5 + n).otherwise(-1.5 + n).alias("z"),
    )


PAINTED = f"""p as (select l_linestatus session, (l_linenumber - 1) * {8 * SECOND} + l_suppkey % 7 * {SECOND} t,
  case l_suppkey % 4 when 0 then 2 + (l_quantity - 25) / 5000 when 1 then -2 + (l_quantity - 25) / 5000 else l_partkey % 26 / 25::double - 0.5 end + (l_linenumber - 1) / 100::double x, l_orderkey % 25 / 25::double y,
  case l_suppkey % 4 when 2 then 1.5 + (l_quantity - 25) / 5000 when 3 then -1.5 + (l_quantity - 25) / 5000 else l_partkey % 26 / 25::double - 0.5 end z from lineitem)"""


def eigen(source: str, out: str) -> str:
    """CTEs that end in ``out``: source with e1 <= e2 <= e3 of its covariances and the unit vector of e1, as the largest column of its projector."""
    return f"""{out}_a as (select *, (cxx + cyy + czz) / 3 q, sqrt(((cxx - q) ** 2 + (cyy - q) ** 2 + (czz - q) ** 2 + 2 * (cxy ** 2 + cxz ** 2 + cyz ** 2)) / 6) d from {source}),
 {out}_b as (select *, acos(greatest(-1, least(1, ((cxx - q) * ((cyy - q) * (czz - q) - cyz * cyz) - cxy * (cxy * (czz - q) - cyz * cxz) + cxz * (cxy * cyz - (cyy - q) * cxz)) / (2 * d ** 3)))) / 3 a,
  q + 2 * d * cos(a + 2 * pi() / 3) e1, q + 2 * d * cos(a) e3, 3 * q - e1 - e3 e2 from {out}_a where d > 0),
 {out}_c as (select *, (e1 - e2) * (e1 - e3) g, (cxx * cxx + cxy * cxy + cxz * cxz - (e2 + e3) * cxx + e2 * e3) / g pxx, (cxx * cxy + cxy * cyy + cxz * cyz - (e2 + e3) * cxy) / g pxy, (cxx * cxz + cxy * cyz + cxz * czz - (e2 + e3) * cxz) / g pxz,
  (cxy * cxy + cyy * cyy + cyz * cyz - (e2 + e3) * cyy + e2 * e3) / g pyy, (cxy * cxz + cyy * cyz + cyz * czz - (e2 + e3) * cyz) / g pyz, (cxz * cxz + cyz * cyz + czz * czz - (e2 + e3) * czz + e2 * e3) / g pzz from {out}_b where e2 > e1),
 {out} as (select * exclude (q, d, a, g), case greatest(pxx, pyy, pzz) when pxx then sqrt(pxx) when pyy then pxy / sqrt(pyy) else pxz / sqrt(pzz) end nx,
  case greatest(pxx, pyy, pzz) when pxx then pxy / sqrt(pxx) when pyy then sqrt(pyy) else pyz / sqrt(pzz) end ny, case greatest(pxx, pyy, pzz) when pxx then pxz / sqrt(pxx) when pyy then pyz / sqrt(pyy) else sqrt(pzz) end nz from {out}_c)"""


COV = ", ".join(f"covar_pop(floor(u{a} * 262144), floor(u{b} * 262144)) / 262144 ** 2 c{a}{b}" for a, b in surfaces.PAIRS)
MEAN = ", ".join(f"avg(floor(u{a} * 262144)) / 262144 m{a}" for a in "xyz")
OFFSET = "abs((ux - mx) * nx + (uy - my) * ny + (uz - mz) * nz)"
WINDOWS = f"""{PAINTED}, s as (select session, min(t) t0 from p group by session),
 a as (select session, (t - t0) // {8 * SECOND} w, x, y, z, floor(x * 4)::bigint i, floor(y * 4)::bigint j, floor(z * 4)::bigint k, x * 4 - floor(x * 4) ux, y * 4 - floor(y * 4) uy, z * 4 - floor(z * 4) uz from p join s using (session)),
 m as (select session, i, j, k, w, count(*) n, {MEAN}, {COV} from a group by all having count(*) >= 8), {eigen('m', 'e')},
 v as (select session, b.w - e.w separation, avg({OFFSET}) off from e join (select session, i, j, k, w from m) o using (session, i, j, k) join a b using (session, i, j, k) where o.w - e.w between 1 and 4 and b.w = o.w and e1 <= 0.09 * e3 group by session, i, j, k, e.w, b.w),
 h as (select *, count(*) over (partition by session, i, j, k, w) n, row_number() over (partition by session, i, j, k, w order by x, y, z) nth from a),
 hm as (select session, i, j, k, w, {MEAN}, {COV} from h where n >= 16 and nth <= n // 2 group by all), {eigen('hm', 'he')},
 hv as (select session, 0 separation, avg({OFFSET}) off from he join h using (session, i, j, k, w) where nth > n // 2 and e1 <= 0.09 * e3 group by session, i, j, k, w),
 l as (select session, separation, list_sort(list(off)) o from (select * from v union all select * from hv) group by all)"""


@query(f"""with {WINDOWS} select session, separation::int separation, len(o) cells, round(o[len(o) // 2 + 1] / 4, 7) median_offset, round(o[least(floor(0.9 * len(o))::int, len(o) - 1) + 1] / 4, 7) p90_offset from l""")
def map_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each window's walls lie from those of the windows before, along their normals."""
    found = surfaces.self_consistency(painted(spark, sf_dir), ["session"])
    return found.select("session", "separation", "cells", r("median_offset", 7).alias("median_offset"), r("p90_offset", 7).alias("p90_offset"))


@query(f"""with {WINDOWS}, n as (select session, count(*) points, (max(t) - min(t)) // {8 * SECOND} + 1 windows from p group by session), f as (select session, min(separation) s from l where separation > 0 group by session)
 select session, points, windows, s is not null measurable, case when s is null then 'no surface was painted twice' end blocker, s::int nearest_separation, round(b.o[len(b.o) // 2 + 1] / 4, 7) nearest_offset, len(b.o) cells,
  round(c.o[len(c.o) // 2 + 1] / 4, 7) self_floor, coalesce(len(c.o), 0) self_cells from n left join f using (session) left join l b on b.session = n.session and b.separation = s left join l c on c.session = n.session and c.separation = 0""")
def map_consistency_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = surfaces.consistency_report(painted(spark, sf_dir), ["session"])
    return found.withColumns({c: r(c, 7) for c in ("nearest_offset", "self_floor")})


@query(f"""with {PAINTED}, t as (select session, floor(t / {8 * SECOND})::bigint w, x, y, z from p), c as (select session, w, floor(x * 4)::bigint i, floor(y * 4)::bigint j, floor(z * 4)::bigint k, x * 4 - floor(x * 4) ux, y * 4 - floor(y * 4) uy, z * 4 - floor(z * 4) uz from t),
 m as (select session, w, i, j, k, count(*) n, {COV} from c group by all having count(*) >= 8), {eigen('m', 'e')}
 select session, w::bigint w, i, j, k, n, round(e1, 9) e1, round(e2, 9) e2, round(e3, 9) e3, round(nx * nx, 6) nxx, round(ny * ny, 6) nyy, round(nz * nz, 6) nzz from e where e2 - e1 > 0.01 * e3""")
def surface_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eigenvalues and normals of all cells of each window."""
    at = surfaces.with_offsets(painted(spark, sf_dir), 0.25).withColumn("w", F.floor(F.col("t") / (8 * SECOND)).cast("long"))
    key = ["session", "w", "i", "j", "k"]
    e = surfaces.with_planes(surfaces.moments(at, key).where("n >= 8")).where("e2 - e1 > 0.01 * e3")
    return e.select(*key, "n", *[r(c, 9).alias(c) for c in ("e1", "e2", "e3")], *[r(F.col(f"n{a}") * F.col(f"n{a}"), 6).alias(f"n{a}{a}") for a in "xyz"])


CLOSE = """p as (select o_orderkey id, o_orderstatus room, case o_orderkey % 3 when 0 then 1.0::double + o_totalprice / 1e8 when 1 then o_custkey % 97 / 97::double else o_orderkey % 89 / 89::double end x,
  case o_orderkey % 3 when 0 then o_custkey % 97 / 97::double when 1 then 1.0::double + o_totalprice / 1e8 else o_custkey % 83 / 83::double end y, case o_orderkey % 3 when 2 then o_totalprice / 1e8 else o_orderkey % 89 / 89::double end z from orders)"""


def corner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as points on three walls of a corner, 5 mm thick."""
    kind, thick = F.col("o_orderkey") % 3, F.col("o_totalprice") / 1e8
    a, b, c = F.col("o_custkey") % 97 / 97.0, F.col("o_orderkey") % 89 / 89.0, F.col("o_custkey") % 83 / 83.0
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("room"),
        F.when(kind == 0, 1.0 + thick).when(kind == 1, a).otherwise(b).alias("x"),
        F.when(kind == 0, a).when(kind == 1, 1.0 + thick).otherwise(c).alias("y"),
        F.when(kind == 2, thick).otherwise(b).alias("z"),
    )


def near_sql(radius: str, by: str = "") -> str:
    same = "and a.room = b.room" if by else ""
    return f"""g as (select *, floor(x / {radius})::bigint i, floor(y / {radius})::bigint j, floor(z / {radius})::bigint k from p),
 c as (select a.id, a.room, b.id target, (b.x - a.x) ** 2 + (b.y - a.y) ** 2 + (b.z - a.z) ** 2 d2, (b.x - a.x) / {radius} ux, (b.y - a.y) / {radius} uy, (b.z - a.z) / {radius} uz
  from g a, (values (-1), (0), (1)) di(di), (values (-1), (0), (1)) dj(dj), (values (-1), (0), (1)) dk(dk), g b where b.i = a.i + di and b.j = a.j + dj and b.k = a.k + dk {same} and (b.x - a.x) ** 2 + (b.y - a.y) ** 2 + (b.z - a.z) ** 2 <= {radius} * {radius})"""


@query(f"""with {CLOSE}, {near_sql('0.0625::double')}, m as (select id, count(*) n, {COV} from c group by id), {eigen('m', 'e')}
 select id, m.n found, case when m.n >= 6 then round(nx * nx, 5) end nxx, case when m.n >= 6 then round(ny * ny, 5) end nyy, case when m.n >= 6 then round(nz * nz, 5) end nzz from m left join e using (id) where m.n < 6 or e.e2 - e.e1 > 0.01 * e.e3""")
def point_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normal of each point's neighbourhood, where it is clear."""
    near = surfaces.normals(corner(spark, sf_dir), 0.0625, clear=0.01)
    return near.where("found < 6 or nx is not null").select("id", "found", *[r(F.col(f"n{a}") * F.col(f"n{a}"), 5).alias(f"n{a}{a}") for a in "xyz"])


@query(f"""with {CLOSE}, {near_sql('0.0625::double', 'room')}, k as (select *, row_number() over (partition by room, id order by d2, target) nth from c),
 m as (select room, id, count(*) n, {COV} from k where nth <= 12 group by all having count(*) >= 6), {eigen('m', 'e')}, f as (select * from e where e2 > 1e-12 and e1 <= 0.1 * e2),
 s as (select room, count(*) planes, {', '.join(f"sum(floor(n{a} * n{b} * 1073741824))::double c{a}{b}" for a, b in surfaces.PAIRS)} from f group by room), {eigen('s', 't')}
 select room, count(*) points, coalesce(any_value(planes), 0) planes, coalesce(round(any_value(case when planes >= 20 then greatest(0, e1 / e3) end), 6), 0) coverage, round(any_value(case when planes >= 20 then nx * nx end), 4) weak_xx from p left join t using (room) group by room""")
def normal_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the normals of each room's surfaces span space."""
    found = surfaces.normal_coverage(corner(spark, sf_dir), ["room"], 0.0625)
    return found.select("room", "points", "planes", r("coverage", 6).alias("coverage"), r(F.col("weak_x") * F.col("weak_x"), 4).alias("weak_xx"))
