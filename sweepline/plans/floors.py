"""Registered queries on floors and levelling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sweepline.operators import floors
from sweepline.plans.queries import query, r
from sweepline.plans.surfaces import SECOND, eigen
from sweepline.session import table


def tilted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as rooms of three sessions, each with a floor that falls by 2, 4 or 6 cm a metre along x, and walls."""
    t = table(spark, sf_dir, "lineitem")
    x, fall = F.col("l_partkey") % 400 / 100.0 - 2, F.when(F.col("l_returnflag") == "A", 0.02).when(F.col("l_returnflag") == "N", 0.04).otherwise(0.06)
    return t.select(
        F.col("l_returnflag").alias("session"), (F.col("l_linenumber") * F.lit(4 * SECOND) + F.col("l_suppkey") % 100 * 10_000_000).alias("t"), x.alias("x"),
        F.when(F.col("l_linenumber") <= 4, fall * x + (F.col("l_discount") - 0.05) / 4).otherwise(F.col("l_quantity") / 20).alias("y"), (F.col("l_orderkey") % 307 / 100.0 - 1.5).alias("z"),
    )


TILTED = """p as (select l_returnflag session, l_partkey % 400 / 100::double - 2 x, l_orderkey % 307 / 100::double - 1.5 z,
  case when l_linenumber <= 4 then (case l_returnflag when 'A' then 0.02::double when 'N' then 0.04::double else 0.06::double end) * (l_partkey % 400 / 100::double - 2) + (l_discount - 0.05::double) / 4 else l_quantity / 20 end y from lineitem)"""


@query(f"""with {TILTED}, o as (select session, count(*) points, list_sort(list(y)) v from p group by session), s as (select session, points, v[floor(0.01::double * (points - 1) + 0.5)::int + 1] lo, v[floor(0.99::double * (points - 1) + 0.5)::int + 1] hi from o),
 b as (select p.session, x, y, z from p join s using (session) where y > lo - 0.05 and y < lo + 0.25 * (hi - lo)), ok as (select session from b group by session having count(*) >= 500),
 d as (select distinct * from b), q as (select *, row_number() over (partition by session order by md5('1,' || floor(x * 65536)::bigint || ',' || floor(y * 65536)::bigint || ',' || floor(z * 65536)::bigint), x, y, z) - 1 nth from d qualify nth < 500), w as (select session, list({{'x': x, 'y': y, 'z': z}} order by nth) s from q join ok using (session) group by session),
 t as (select session, h, s[h % len(s) + 1] a, s[(7 * h + 1) % len(s) + 1] b, s[(13 * h + 5) % len(s) + 1] c from w, range(500) r(h)),
 h as (select session, h, a.x ax, a.y ay, a.z az, (b.y - a.y) * (c.z - a.z) - (b.z - a.z) * (c.y - a.y) cx, (b.z - a.z) * (c.x - a.x) - (b.x - a.x) * (c.z - a.z) cy, (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) cz, sqrt(cx * cx + cy * cy + cz * cz) len from t),
 f as (select session, h, k * cx nx, k * cy ny, k * cz nz, -(nx * ax + ny * ay + nz * az) d from (select *, (case when cy < 0 then -1.0::double else 1.0::double end) / len k from h where len > 0) where k * cy >= 0.70710678),
 c as (select session, h, count(*) n from b join f using (session) where abs(nx * x + ny * y + nz * z + d) < 0.02 group by all), g as (select session, h from c qualify row_number() over (partition by session order by n desc, h) = 1),
 i as (select b.* from b join g using (session) join f using (session, h) where abs(nx * x + ny * y + nz * z + d) < 0.02), m as (select session, count(*) inliers, count(distinct (floor(x * 4), floor(z * 4))) / 16 area, covar_pop(floor(x * 65536), floor(x * 65536)) / 65536 ** 2 cxx,
  covar_pop(floor(x * 65536), floor(y * 65536)) / 65536 ** 2 cxy, covar_pop(floor(x * 65536), floor(z * 65536)) / 65536 ** 2 cxz, covar_pop(floor(y * 65536), floor(y * 65536)) / 65536 ** 2 cyy, covar_pop(floor(y * 65536), floor(z * 65536)) / 65536 ** 2 cyz, covar_pop(floor(z * 65536), floor(z * 65536)) / 65536 ** 2 czz from i group by session), {eigen('m', 'e')}
 select session, points, case when points < 1000 then 'not-enough-data' when ny is null then 'no-floor' when inliers < 1500 or area < 1 then 'thin-floor' else 'found' end state, inliers, area, round(degrees(acos(least(1, abs(ny)))), 5) tilt, round(nx * sign(ny), 6) nx, round(nz * sign(ny), 6) nz from s left join e using (session)""")
def floor_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The floor of each session: the plane that most points of the low band lie on, refitted."""
    found = floors.floor_planes(tilted(spark, sf_dir), ["session"])
    return found.select("session", "points", "state", "inliers", "area", r("tilt", 5).alias("tilt"), r("nx", 6).alias("nx"), r("nz", 6).alias("nz"))


@query()
def auto_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions levelled by their floors, through poses that stand still; tests compare tilts and turns with known ones."""
    sessions = tilted(spark, sf_dir).select("session").distinct()
    ticks = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(32 * SECOND), F.lit(8 * SECOND)))
    pose = dict.fromkeys(("px", "pz", "qx", "qz"), 0.0) | {"py": 1.2, "qy": 0.0, "qw": 1.0, "sigma": 0.01, "confidence": 1.0}
    poses = sessions.select("session", ticks.alias("t")).select("session", "t", *[F.lit(v).alias(k) for k, v in pose.items()], F.lit(2).alias("quality"), F.lit(False).alias("lost"))
    _, report = floors.levelled(tilted(spark, sf_dir), poses, "session", 32 * SECOND)
    return report.select("session", "decision", "rounds", *[r(c, 4).alias(c) for c in ("tilt_before", "tilt_after", "angle")])
