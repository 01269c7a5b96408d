"""Registered queries on the fixed tables, each with its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sweepline.functions import geodesy, geometry
from sweepline.operators import asof, merge, ordered, spatial
from sweepline.operators.prefix import with_previous, with_running
from sweepline.plans.bindings import CLOUD, ORDER, TRACK, VECTORS, cloud, track, vectors
from sweepline.session import table
from sweepline.sources import packets, sinks

HOUR = 3_600_000_000


def weeks() -> Column:
    """A bucket of t for orders by time."""
    return F.expr(f"t div {168 * HOUR}")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r(c: Column | str, n: int = 6) -> Column:
    return F.round(c, n)


# ---- clouds --------------------------------------------------------------------------------------------------

SESSIONS = (("A", 2, True, 0.25, -0.5, 0.0), ("N", 1, False, 0.0, 0.0, 0.0), ("R", 1, True, -0.5, 0.25, 0.0))


@query(f"""with {CLOUD}, s(session, priority, converged, dx, dy, dz) as (values {', '.join(str(s) for s in SESSIONS)}),
 means as (select session, priority, converged, floor((x + dx) * 0.5)::bigint vi, floor((y + dy) * 0.5)::bigint vj, floor((z + dz) * 0.5)::bigint vk,
  avg(x + dx)::float::double x, avg(y + dy)::float::double y, avg(z + dz)::float::double z from cloud join s using (session) group by all),
 ranked as (select *, floor(x * 0.25)::bigint i, floor(y * 0.25)::bigint j, floor(z * 0.25)::bigint k from means),
 claimed as (select *, row_number() over (partition by i, j, k order by not converged, priority, session, vi, vj, vk) rn,
  count(*) over (partition by i, j, k) claims from ranked)
 select i, j, k, session, round(x, 3) x, round(y, 3) y, round(z, 3) z, claims from claimed where rn = 1""")
def merge_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = spark.createDataFrame(list(SESSIONS), "session string, priority int, converged boolean, dx double, dy double, dz double")
    built = merge.merge_build(cloud(spark, sf_dir), sessions, voxel=2.0, claim=4.0)
    return built.select("i", "j", "k", "session", *[r(a, 3).alias(a) for a in "xyz"], "claims")


@query(f"""with {CLOUD} select session, floor(x * 0.5)::bigint i, floor(y * 0.5)::bigint j, floor(z * 0.5)::bigint k,
 round(avg(x), 10) x, round(avg(y), 10) y, round(avg(z), 10) z, count(*) n from cloud group by all""")
def voxel_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spatial.voxel_downsample(cloud(spark, sf_dir), 2.0, by=("session",))
    return v.select("session", "i", "j", "k", *[r(a, 10).alias(a) for a in "xyz"], "n")


@query(f"""with {CLOUD}, o as (select *, floor(x * 0.2)::bigint i, floor(y * 0.2)::bigint j, floor(z * 0.2)::bigint k from cloud)
 select i, j, k, l_orderkey, l_linenumber, l_partkey, l_suppkey, x, y, z, n from (select *, count(*) over (partition by i, j, k) n,
  row_number() over (partition by i, j, k order by l_orderkey, l_linenumber, l_partkey, l_suppkey, x, y, z) rn from o) where rn = 1""")
def voxel_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.voxel_first(cloud(spark, sf_dir), 5.0, ORDER)


@query(f"""with {CLOUD}, g as (select floor(x * 1.0)::bigint i, floor(y * 1.0)::bigint j, count(*) n from cloud where z between 2 and 8 group by all)
 select i - min(i) over () i, j - min(j) over () j, n, n >= 3 occupied from g""")
def occupancy_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.occupancy_grid(cloud(spark, sf_dir), 1.0, 2, 8, 3)


@query(f"""with {CLOUD} select floor(x * 0.5)::bigint i, floor(y * 0.5)::bigint j, round(max(z) - min(z), 6) span from cloud
 where z between 1 and 9 group by all having max(z) - min(z) >= 5""")
def wall_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.wall_likeness(cloud(spark, sf_dir), 2.0, 1, 9, 5).withColumn("span", r("span"))


INCLUDE, EXCLUDE = ((5.0, 5.0, 40.0, 90.0),), ((10.0, 10.0, 20.0, 30.0), (30.0, 50.0, 35.0, 60.0))


@query(f"""with {CLOUD} select session, count(*) n from cloud where not (x between 10 and 20 and y between 10 and 30)
 and not (x between 30 and 35 and y between 50 and 60) and x between 5 and 40 and y between 5 and 90 group by session""")
def region_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cloud(spark, sf_dir).where(geometry.region_mask(F.col("x"), F.col("y"), INCLUDE, EXCLUDE)).groupBy("session").agg(F.count("*").alias("n"))


@query(f"""with {CLOUD} select session, count(distinct (floor(x * 0.5), floor(y * 0.5), floor(z * 0.5))) voxels from cloud group by session""")
def crispness_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.crispness(cloud(spark, sf_dir), 2.0, by=("session",))


@query(f"""with {CLOUD}, v as (select max(t) - min(t) span from cloud group by floor(x * 0.5), floor(y * 0.5), floor(z * 0.5))
 select count(*) voxels, round(avg((span >= 2592000000000)::int), 9) overlap from v""")
def revisit_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.revisit_overlap(cloud(spark, sf_dir), 2.0, 30 * 24 * HOUR).withColumn("overlap", r("overlap", 9))


@query(f"""with {CLOUD}, v as (select count(*)::double n from cloud group by floor(x * 0.5), floor(y * 0.5), floor(z * 0.5)),
 p as (select n / sum(n) over () p from v) select count(*) voxels, round(-sum(p * log2(p)), 6) bits from p""")
def voxel_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.voxel_entropy(cloud(spark, sf_dir), 2.0).withColumn("bits", r("bits"))


@query(f"""with {CLOUD}, g as (select floor(x * 0.25)::bigint i, floor(y * 0.25)::bigint j, count(*) n from cloud group by all)
 select i, j, n, round(case when n <= 8 then 0 when n >= 40 then 1 else (n - 8) / 32.0 end, 9) as "level" from g""")
def coverage_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.coverage(cloud(spark, sf_dir), 4.0).withColumn("level", r("level", 9))


@query(f"""with {CLOUD}, b as (select degrees(atan2(x - 25, y - 50)) d from cloud),
 c as (select least(floor((case when d < 0 then d + 360 else d end) / 30.0)::int, 11) sector, count(*) n from b group by all),
 f as (select s::int sector, coalesce(n, 0) n from range(12) t(s) left join c on c.sector = s) select sector, n, n < 0.15 * sum(n) over () / 12.0 thin from f""")
def coverage_compass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.coverage_compass(cloud(spark, sf_dir), 25.0, 50.0)


@query(f"""with {CLOUD} select session, min(x) min_x, min(y) min_y, min(z) min_z, max(x) max_x, max(y) max_y, max(z) max_z, count(*) n from cloud group by session""")
def cloud_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.bounds(cloud(spark, sf_dir), by=("session",))


PAIRS = f"""with {VECTORS}, pairs as (select a.id q, b.id, (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z) d2
 from vectors a, vectors b where d2 <= 0.0225)"""


@query(f"{PAIRS} select q, id, rank, round(d2, 9) d2 from (select *, row_number() over (partition by q order by d2, id) rank from pairs) where rank <= 4")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return spatial.knn(v.withColumnRenamed("id", "q"), v, 0.15, 4, ["id"]).select("q", "id", "rank", r("d2", 9).alias("d2"))


@query(f"""{PAIRS}, k as (select q, d2, row_number() over (partition by q order by d2, id) rank from pairs),
 e as (select q, count(*) found, case when count(*) > 3 then sum(sqrt(d2)) / (count(*) - 1) end mean_d from k where rank <= 9 group by q),
 m as (select avg(mean_d) + 1.5 * stddev_pop(mean_d) lim from e)
 select q as id, found, round(mean_d, 9) mean_d, case when mean_d is null then 'isolated' when mean_d > lim then 'outlier' else 'kept' end status from e, m""")
def outlier_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.outlier_filter(vectors(spark, sf_dir), 0.15).withColumn("mean_d", r("mean_d", 9))


@query(f"""with {VECTORS}, pairs as (select a.id, min((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z)) d2
 from vectors a, vectors b where a.stream < 5 and b.stream >= 5 group by a.id) select count(*) pairs, round(avg(sqrt(d2)), 9) mean_d from pairs where d2 <= 0.0225""")
def mean_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    near = spatial.knn(v.where("stream < 5").withColumnRenamed("id", "q"), v.where("stream >= 5"), 0.15, 1, ["id"])
    return near.agg(F.count("*").alias("pairs"), r(F.avg(F.sqrt("d2")), 9).alias("mean_d"))


def _near(a: str, b: str) -> str:
    return f"""(select avg((exists (select 1 from o where o.s = {b} and o.i - floor((v.x - 0.05) * 10.0) between 0 and 1
 and o.j - floor((v.y - 0.05) * 10.0) between 0 and 1 and o.k - floor((v.z - 0.05) * 10.0) between 0 and 1))::int) from vectors v where (v.stream >= 5) = ({a} = 1))"""


@query(f"""with {VECTORS}, o as (select distinct (stream >= 5)::int s, floor(x * 10.0) i, floor(y * 10.0) j, floor(z * 10.0) k from vectors),
 f as (select {_near('0', '1')} a, {_near('1', '0')} b) select round(a, 9) a_in_b, round(b, 9) b_in_a, round(least(a, b), 9) overlap from f""")
def session_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    found = spatial.overlap(v.where("stream < 5"), v.where("stream >= 5"), 0.1)
    return found.select(*[r(c, 9).alias(c) for c in found.columns])


@query(f"""with {CLOUD}, h as (select session, floor(y / 5.0)::bigint bin, count(*) n from cloud group by all), s as (select unnest(range(-6, 7)) shift),
 c as (select shift, sum(a.n * b.n) score from s, h a, h b where a.session = 'A' and b.session = 'N' and a.bin = b.bin + shift group by shift)
 select shift, score::bigint score, row_number() over (order by score desc, abs(shift), shift) rank from c""")
def histogram_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = spatial.histogram(cloud(spark, sf_dir), "y", 5.0, by=("session",))
    of = lambda s: h.where(F.col("session") == s).select("bin", "n")
    return spatial.best_shift(of("A"), of("N"), 6)


@query(f"""with {VECTORS}, p as (select stream, sqrt(x * x + y * y) r, degrees(atan2(y, x)) a, z from vectors)
 select stream frame, floor(r / 0.05)::int ring, least(floor((case when a < 0 then a + 360 else a end) / 30.0)::int, 11) sector, round(max(z), 9) top from p where r < 0.5 group by all""")
def scan_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).withColumnRenamed("stream", "frame")
    return spatial.ring_sector(v, rings=10, sectors=12, reach=0.5).withColumn("top", r("top", 9))


@query(f"""with {CLOUD}, w as (select floor(x * 0.1)::bigint i, floor(y * 0.1)::bigint j, floor(z * 0.5)::bigint k, floor((t - (select min(t) from cloud)) / 15552000000000)::bigint w from cloud),
 c as (select i, j, k, w, count(*) n from w group by all having count(*) >= 8)
 select b.w - a.w apart, count(*) pairs, sum(a.n * b.n)::bigint weight from c a join c b using (i, j, k) where b.w - a.w between 1 and 4 group by all""")
def map_windows_shared_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = cloud(spark, sf_dir)
    start = p.agg(F.min("t").alias("t0"))
    cells = [F.floor(F.col(a) * s).cast("long").alias(c) for a, s, c in (("x", 0.1, "i"), ("y", 0.1, "j"), ("z", 0.5, "k"))]
    at = p.join(F.broadcast(start), F.lit(True)).select(*cells, F.expr("(t - t0) div 15552000000000").alias("w"))
    c = at.groupBy("i", "j", "k", "w").agg(F.count("*").alias("n")).where("n >= 8")
    both = c.join(c.select("i", "j", "k", F.col("w").alias("w2"), F.col("n").alias("n2")), ["i", "j", "k"]).where("w2 - w between 1 and 4")
    return both.groupBy(F.expr("w2 - w").alias("apart")).agg(F.count("*").alias("pairs"), F.sum(F.expr("n * n2")).alias("weight"))


@query(f"""with {VECTORS}, c as (select stream, count(*) n, covar_pop(x, x) xx, covar_pop(x, y) xy, covar_pop(y, y) yy from vectors group by stream)
 select stream, n, round((xx + yy) / 2 + sqrt(((xx - yy) / 2) ** 2 + xy * xy), 9) l1, round((xx + yy) / 2 - sqrt(((xx - yy) / 2) ** 2 + xy * xy), 9) l2 from c""")
def wall_thickness_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spatial.plane_fit(vectors(spark, sf_dir), by=("stream",))
    l1, l2 = geometry_eigen(c)
    return c.select("stream", "n", r(l1, 9).alias("l1"), r(l2, 9).alias("l2"))


def geometry_eigen(c: DataFrame) -> tuple[Column, Column]:
    return spatial.eigenvalues_2d(F.col("cxx"), F.col("cxy"), F.col("cyy"))


@query(f"""with {CLOUD}, q as (select *, case when (x - 1) ** 2 + z ** 2 = 0 then 'no_return' when l_partkey % 16 in (1, 3) then 'tag' when l_suppkey % 100 < 7 then 'reflectivity'
  when (x - 1) ** 2 + z ** 2 < 4 or (x - 1) ** 2 + z ** 2 > 2025 then 'range' else 'in' end reason from cloud) select session, reason, count(*) n from q group by all""")
def yield_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points by their first reason to be left out."""
    p = cloud(spark, sf_dir).select("session", (F.col("x") - 1).alias("x"), F.lit(0.0).alias("y"), "z", F.when((F.col("l_partkey") % 16).isin(1, 3), F.col("l_partkey") % 16).otherwise(0).alias("tag"), (F.col("l_suppkey") % 100).alias("reflectivity"))
    why = F.coalesce(packets.reject_reason(low_reflectivity=7, near=2.0, far=45.0), F.lit("in"))
    return p.groupBy("session", why.alias("reason")).agg(F.count("*").alias("n"))


@query(f"""with {CLOUD}, m as (select (min(x) + max(x)) / 2 ox, (min(y) + max(y)) / 2 oy, (min(z) + max(z)) / 2 oz from cloud)
 select session, sum(round((x - ox) / 0.001))::bigint qx, sum(round((y - oy) / 0.01))::bigint qy, sum(round((z - oz) / 0.1))::bigint qz from cloud, m group by session""")
def las_quantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = cloud(spark, sf_dir)
    m = spatial.bounds(p).select(*[((F.col(f"min_{a}") + F.col(f"max_{a}")) / 2).alias(f"o{a}") for a in "xyz"])
    q = p.join(F.broadcast(m), F.lit(True))
    scales = {"x": 0.001, "y": 0.01, "z": 0.1}
    return q.groupBy("session").agg(*[F.sum(geometry.quantised(F.col(a), F.col(f"o{a}"), s)).alias(f"q{a}") for a, s in scales.items()])


@query(f"""with {VECTORS}, n as (select *, row_number() over (order by id) - 1 nth from vectors where stream in (1, 3, 5, 7))
 select id, stream from n where nth % 3 = 0 and x between -0.3 and 0.3 and y between -0.3 and 0.3 and z between -0.3 and 0.3""")
def export_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.selected(vectors(spark, sf_dir), [1, 3, 5, 7], 3, (-0.3,) * 3, (0.3,) * 3, ["id"], F.expr("id div 1000")).select("id", "stream")


@query("""select p_partkey, floor((299 * (p_size * 5) + 587 * (p_size * 3) + 114 * p_size + 500) / 1000.0)::int luma,
 round(power(1 - least(1, greatest(0, (p_retailprice - 950) / 500)), 0.8), 6) scalar from part""")
def luma_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey", geometry.luma(s * 5, s * 3, s).alias("luma"), r(geometry.scalar_of(F.col("p_retailprice"), 950, 1450, 0.8, True)).alias("scalar")
    )


# ---- transforms ----------------------------------------------------------------------------------------------

#: A turn about z by the angle of (3, 4), and a shift.
MOUNT = [0.6, -0.8, 0.0, 1.5, 0.8, 0.6, 0.0, -2.0, 0.0, 0.0, 1.0, 0.25, 0.0, 0.0, 0.0, 1.0]


@query(f"""with {VECTORS}, p as (select id, 0.6 * x - 0.8 * y + 1.5 as x, 0.8 * x + 0.6 * y - 2 as y, z + 0.25 as z from vectors)
 select id, round(x, 9) x, round(y, 9) y, round(z, 9) z from p""")
def rigid_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, z = geometry.transformed(MOUNT, F.col("x"), F.col("y"), F.col("z"))
    return vectors(spark, sf_dir).select("id", r(x, 9).alias("x"), r(y, 9).alias("y"), r(z, 9).alias("z"))


@query(f"""with {VECTORS} select id, round(x, 6) bx, round(y, 6) "by", round(z, 6) bz from vectors""")
def rigid_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = geometry.transformed(MOUNT, F.col("x"), F.col("y"), F.col("z"))
    back = geometry.transformed(geometry.inverse(MOUNT), *there)
    return vectors(spark, sf_dir).select("id", *[r(c, 6).alias(f"b{a}") for a, c in zip("xyz", back, strict=True)])


@query(f"""with {TRACK}, p as (select event_id, (event_id % 3600) / 10.0 as angle, 1 + value / 100 as range from track)
 select event_id, round(-range * sin(radians(angle)), 6) x, round(range * cos(radians(angle)), 6) y, round(angle, 6) back from p""")
def polar_fan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = track(spark, sf_dir).select("event_id", (F.col("event_id") % 3600 / 10.0).alias("angle"), (1 + F.col("value") / 100).alias("range"))
    x, y, _ = geometry.fan(F.col("angle"), F.col("range"))
    back = r(geometry.fan_angle(x, y))
    return p.select("event_id", r(x).alias("x"), r(y).alias("y"), F.when(back == 360, 0.0).otherwise(back).alias("back"))


@query("""with p as (select c_custkey, radians((c_custkey % 170) / 8.0) a, (c_custkey % 11) / 10.0 u, radians((c_custkey % 7) * 10.0) t from customer),
 s as (select *, cos(a / 2) > 0.9995 line from p), m as (select *, case when line then 1 - u + u * cos(a / 2) else cos(a * u / 2) end w, case when line then u * sin(a / 2) else sin(a * u / 2) end v from s)
 select c_custkey, round(v / sqrt(v * v + w * w) * sin(t), 6) qx, round(v / sqrt(v * v + w * w) * cos(t), 6) qz, round(w / sqrt(v * v + w * w), 6) qw, round(degrees(a), 6) turn from m""")
def quaternion_slerp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns about axes in the plane of x and z; the narrow ones take a straight line."""
    a, u, t = F.radians((F.col("c_custkey") % 170) / 8.0), F.col("c_custkey") % 11 / 10.0, F.radians(F.col("c_custkey") % 7 * 10.0)
    zero = F.lit(0.0)
    # the other sign is the same turn: the short arc flips it back
    start, end = (zero, zero, zero, F.lit(1.0)), (-F.sin(a / 2) * F.sin(t), zero, -F.sin(a / 2) * F.cos(t), -F.cos(a / 2))
    q = geometry.slerp(start, end, u)
    return table(spark, sf_dir, "customer").select("c_custkey", r(q[0]).alias("qx"), r(q[2]).alias("qz"), r(q[3]).alias("qw"), r(geometry.turn_degrees(start, end)).alias("turn"))


# ---- geodesy and NMEA ----------------------------------------------------------------------------------------

GEO = """geo as (select c_custkey, (c_custkey * 7919 % 160000) / 1000.0 - 80 as lat, (c_custkey * 104729 % 360000) / 1000.0 - 180 as lon, c_acctbal / 10 as h from customer)"""


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", (k * 7919 % 160000 / 1000.0 - 80).alias("lat"), (k * 104729 % 360000 / 1000.0 - 180).alias("lon"), (F.col("c_acctbal") / 10).alias("h"))


N = f"({geodesy.A} / sqrt(1 - {geodesy.E2!r} * sin(radians(lat)) ** 2))"


@query(f"""with {GEO} select c_custkey, round(({N} + h) * cos(radians(lat)) * cos(radians(lon)), 3) x, round(({N} + h) * cos(radians(lat)) * sin(radians(lon)), 3) y,
 round(({N} * (1 - {geodesy.E2!r}) + h) * sin(radians(lat)), 3) z, round(lat, 7) back_lat, round(lon, 7) back_lon, round(h, 3) back_h from geo""")
def geodetic_ecef_enu(spark: SparkSession, sf_dir: str) -> DataFrame:
    xyz = geodesy.to_ecef(F.col("lat"), F.col("lon"), F.col("h"))
    g = geo(spark, sf_dir).select("*", *[c.alias(a) for a, c in zip("xyz", xyz, strict=True)])
    lat, lon, h = geodesy.to_geodetic(F.col("x"), F.col("y"), F.col("z"))
    return g.select("c_custkey", *[r(a, 3).alias(a) for a in "xyz"], r(lat, 7).alias("back_lat"), F.when(r(lon, 7) == 180, -180.0).otherwise(r(lon, 7)).alias("back_lon"), r(h, 3).alias("back_h"))


@query(f"""with {GEO} select c_custkey, case when lat >= 56 and lat < 64 and lon >= 3 and lon < 12 then 32 when lat >= 72 and lat < 84 and lon >= 0 and lon < 9 then 31
 when lat >= 72 and lat < 84 and lon >= 9 and lon < 21 then 33 when lat >= 72 and lat < 84 and lon >= 21 and lon < 33 then 35 when lat >= 72 and lat < 84 and lon >= 33 and lon < 42 then 37
 else (floor((lon + 180) / 6)::int % 60) + 1 end zone from geo""")
def utm_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo(spark, sf_dir).select("c_custkey", geodesy.utm_zone(F.col("lat"), F.col("lon")).alias("zone"))


# ---- tracks --------------------------------------------------------------------------------------------------


@query(f"""with {TRACK}, k as (select user_id, t, max(value) as value from track where event_type = 'view' group by all), p as (select event_id, user_id, t from track where event_type = 'click'),
 l as (select p.*, k.t t0, k.value v0 from p asof left join k on p.user_id = k.user_id and p.t >= k.t),
 b as (select l.*, case when l.t0 = l.t then l.t0 else n.t end t1, case when l.t0 = l.t then l.v0 else n.value end v1 from l asof left join k n on l.user_id = n.user_id and l.t < n.t)
 select event_id, user_id, t0, t1, case when t0 is null and t1 is null then 'no_data' when t0 is null then 'before_first' when t1 is null then 'future' when t1 - t0 > 86400000000 then 'gap' else 'ok' end state,
 round(case when t0 = t1 then v0 else v0 + (v1 - v0) * ((t - t0)::double / (t1 - t0)) end, 6) as value from b""")
def asof_pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = track(spark, sf_dir)
    knots = e.where("event_type = 'view'").groupBy("user_id", "t").agg(F.max("value").alias("value"))
    b = asof.brackets(e.where("event_type = 'click'").select("event_id", "user_id", "t"), knots, "user_id", ["value"], bucket=48 * HOUR)
    return b.select("event_id", "user_id", F.col("before.t").alias("t0"), F.col("after.t").alias("t1"), asof.gate(24 * HOUR).alias("state"), r(asof.interpolated("value")).alias("value"))


@query(f"""with {TRACK}, a as (select *, t > coalesce(max(t) over (partition by user_id order by (event_id * 7919) % 10007, event_id rows between unbounded preceding and 1 preceding), -1) ok from track)
 select user_id, count(*) filter (ok) accepted, count(*) filter (not ok) rejected from a group by user_id""")
def arrival_order_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = track(spark, sf_dir).withColumn("arrival", F.struct((F.col("event_id") * 7919 % 10007).alias("a"), "event_id"))
    a = asof.in_arrival_order(e, "user_id", "arrival", "t", F.expr("arrival.a div 1000"))
    return a.groupBy("user_id").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"))


@query(f"""with {TRACK}, l as (select *, coalesce((t - lag(t) over w > 43200000000)::int, 0) b from track window w as (partition by user_id order by t, event_id)),
 s as (select *, sum(b) over (partition by user_id order by t, event_id rows unbounded preceding) section from l)
 select user_id, section::bigint section, count(*) n, min(t) t_first, max(t) t_last from s group by all""")
def section_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["t", "event_id"]
    at = with_previous(track(spark, sf_dir), ["user_id"], order, {"before": "t"}, weeks(), keep=True)
    s = ordered.sections(at, ["user_id"], order, F.col("t") - F.col("before") > 12 * HOUR, weeks())
    return s.groupBy("user_id", "section").agg(F.count("*").alias("n"), F.min("t").alias("t_first"), F.max("t").alias("t_last"))


@query(f"""with {TRACK}, s as (select *, coalesce(abs(value - lag(value) over (partition by user_id order by t, event_id)), 0) step from track),
 p as (select *, sum(step) over (partition by user_id order by t, event_id rows unbounded preceding) path, sum(step) over (partition by user_id) whole from s)
 select event_id, round(path, 5) path, round(case when whole > 0 then path / whole else 0 end, 6) loop_fraction from p""")
def path_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ordered.path_length(track(spark, sf_dir), ["user_id"], ["t", "event_id"], ["value"], weeks())
    return p.select("event_id", r("path", 5).alias("path"), r("loop_fraction").alias("loop_fraction"))


KNOTS = f"""with {TRACK}, d as (select user_id, t // 86400000000 n, max(value) x from track group by all),
 s as (select *, n * 86400000000 t, coalesce(abs(x - lag(x) over (partition by user_id order by n)), 0) step from d),
 k as (select *, round(sum(step) over (partition by user_id order by n rows unbounded preceding), 3) path from s)"""


@query(f"""{KNOTS}, p as (select a.user_id, a.n a, b.n b, a.t ta, b.t tb, abs(b.x - a.x) gap, b.path - a.path length from k a join k b on a.user_id = b.user_id and b.n > a.n),
 e as (select *, max(gap) over (partition by user_id, a order by b rows unbounded preceding) excursion from p),
 c as (select *, row_number() over (partition by user_id order by length desc, gap, a, b) rn from e where tb - ta >= 259200000000 and length >= 8 and gap <= 3 and excursion >= 4)
 select user_id, a, b, round(length, 3) length, round(gap, 3) gap, round(excursion, 3) excursion from c where rn = 1""")
def loop_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = 24 * HOUR
    k = track(spark, sf_dir).groupBy("user_id", F.expr(f"t div {day}").alias("n")).agg(F.max("value").alias("x")).withColumn("t", F.col("n") * day)
    k = ordered.path_length(k, ["user_id"], ["n"], ["x"], F.expr("n div 7")).withColumn("path", F.round("path", 3))
    found = ordered.loop_candidates(k, "user_id", 3 * day, 8, 3, 4)
    return found.select("user_id", "a", "b", *[r(c, 3).alias(c) for c in ("length", "gap", "excursion")])


@query("""with i as (select l_suppkey, epoch_us(l_shipdate) // 86400000000 lo, epoch_us(l_shipdate) // 86400000000 + (l_quantity / 10)::int hi from lineitem),
 f as (select *, max(hi) over (partition by l_suppkey order by lo, hi rows between unbounded preceding and 1 preceding) reach from i),
 s as (select *, sum(coalesce((lo > reach + 1)::int, 0)) over (partition by l_suppkey order by lo, hi rows unbounded preceding) section from f)
 select l_suppkey, min(lo) lo, max(hi) hi, count(*) n from s group by l_suppkey, section""")
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "lineitem").select("l_suppkey", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', l_shipdate) div 86400000000").alias("lo"), F.round(F.bround(F.col("l_quantity") / 10)).cast("long").alias("days"))
    i = i.select("l_suppkey", "lo", (F.col("lo") + F.col("days")).alias("hi"))
    return ordered.merged_intervals(i, ["l_suppkey"], 1, F.expr("lo div 100")).select("l_suppkey", "lo", "hi", "n")


@query("""with v as (select l_suppkey, l_extendedprice / 1000 x from lineitem), g as (select *, coalesce((x - lag(x) over (partition by l_suppkey order by x) > 0.25)::int, 0) b from v),
 s as (select *, sum(b) over (partition by l_suppkey order by x rows unbounded preceding) section from g)
 select l_suppkey, round(min(x) - 0.05, 6) lo, round(max(x) + 0.05, 6) hi, count(*) n from s group by l_suppkey, section having max(x) + 0.05 - (min(x) - 0.05) >= 0.3""")
def runs_on_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_extendedprice") / 1000).alias("x"))
    return ordered.runs(v, ["l_suppkey"], "x", 0.25, 0.05, 0.3, F.floor(F.col("x") / 10)).select("l_suppkey", r("lo").alias("lo"), r("hi").alias("hi"), "n")


@query(f"""with {TRACK}, p as (select user_id, t device, t + 1000 + (value * 10)::bigint arrival from track), w as (select *, (device - min(device) over (partition by user_id)) // 86400000000 w, arrival - device delta from p),
 m as (select user_id, w, min((delta, device)) m from w group by all), q as (select user_id, m[2] x, m[1] y from m),
 s as (select user_id, count(*) windows, coalesce(greatest(-0.0005, least(0.0005, regr_slope(y, x))), 0) slope from q group by user_id)
 select user_id, windows, round(slope, 12) slope, round(min(y - slope * (x - 1700000000000000)), 2) intercept from q join s using (user_id) group by all""")
def min_delay_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    t0 = 1_700_000_000_000_000
    p = track(spark, sf_dir).select("user_id", (F.col("t") - t0).alias("device"), (F.col("t") - t0 + 1000 + F.bround(F.col("value") * 10).cast("long")).alias("arrival"))
    m = ordered.min_delay_envelope(p, "user_id", 24 * HOUR, 0.0005)
    return m.select("user_id", "windows", r("slope", 12).alias("slope"), r("intercept", 2).alias("intercept"))


@query(f"""with {TRACK}, w as (select event_id, user_id, list_sort(list(value) over (partition by user_id order by t, event_id rows between 31 preceding and current row)) v from track)
 select event_id, round(v[greatest(1, ceil(0.95 * len(v)))::int] - v[greatest(1, ceil(0.05 * len(v)))::int], 6) jitter from w""")
def jitter_p95_p5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.jitter(track(spark, sf_dir), "user_id", ["t", "event_id"], "value", last=32).select("event_id", r("jitter").alias("jitter"))


@query(f"""with {TRACK}, g as (select user_id, (event_id - lag(event_id) over (partition by user_id order by event_id)) % 65536 gap from track)
 select user_id, count(*) packets, count(*) filter (gap = 1) in_sequence, count(*) filter (gap = 0) duplicates, count(*) filter (gap >= 1024) resets,
 sum(case when gap > 1 and gap < 1024 then gap - 1 else 0 end)::bigint lost,
 round(sum(case when gap > 1 and gap < 1024 then gap - 1 else 0 end) / (sum(case when gap > 1 and gap < 1024 then gap - 1 else 0 end) + count(*))::double, 9) loss from g group by user_id""")
def loss_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = track(spark, sf_dir).withColumn("counter", F.col("event_id") % 65536)
    return ordered.loss_tracker(e, "user_id", ["event_id"], "counter", F.expr("event_id div 10000")).withColumn("loss", r("loss", 9))


@query(f"""with {TRACK}, s as (select *, t // 21600000000 scan from track), n as (select user_id, scan, count(*) points from s group by all),
 d as (select *, greatest(1, ceil(coalesce(lag(points) over (partition by user_id order by scan), 0) / 2.0))::bigint stride from n),
 k as (select s.*, row_number() over (partition by user_id, scan order by t, event_id) - 1 nth from s)
 select user_id, scan, points, stride, count(*) kept from k join d using (user_id, scan) where nth % stride = 0 group by all""")
def scan_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.scan_assembly(track(spark, sf_dir), "user_id", "t", ["event_id"], 6 * HOUR, 2)


@query(f"""with {TRACK}, g as (select event_type, t // 3600000000 i, sum(value) v from track where event_type in ('view', 'click') group by all),
 c as (select event_type, i, v - avg(v) over (partition by event_type) v from g), s as (select unnest(range(-5, 6)) lag),
 j as (select lag, sum(a.v * b.v) ab, sum(a.v * a.v) aa, sum(b.v * b.v) bb, count(*) n from s, c a, c b where a.event_type = 'view' and b.event_type = 'click' and b.i = a.i + lag group by lag)
 select lag, n, round(case when sqrt(aa * bb) > 0 then ab / sqrt(aa * bb) else 0 end, 6) ncc from j""")
def clock_sweep_ncc(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = track(spark, sf_dir).groupBy("event_type", F.expr(f"t div {HOUR}").alias("i")).agg(F.sum("value").alias("v"))
    of = lambda kind: g.where(F.col("event_type") == kind).select("i", "v")
    return ordered.cross_correlation(of("view"), of("click"), 5).withColumn("ncc", r("ncc"))


# ---- tables of jobs and texts --------------------------------------------------------------------------------


@query("""select o_orderkey, row_number() over (partition by o_orderstatus order by o_orderpriority, o_orderkey, o_custkey, o_totalprice) turn, o_orderstatus from orders""")
def job_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each state's jobs in their order: higher priority first, then the older job; counted in buckets of a priority's keys."""
    order = ["o_orderpriority", "o_orderkey", "o_custkey", "o_totalprice"]
    bucket = F.struct("o_orderpriority", F.expr("o_orderkey div 4096").alias("k"))
    jobs = with_running(table(spark, sf_dir, "orders").select("o_orderstatus", *order), ["o_orderstatus"], order, {"turn": F.lit(1).cast("long")}, bucket)
    return jobs.select("o_orderkey", "turn", "o_orderstatus")


@query("select o_orderstatus, count(*) n, round(sum(o_totalprice), 2) total from orders group by all")
def job_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))


@query("""select doc_id, left(trim(regexp_replace(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), '[^ -~]|["\\\\]', '', 'g'), ' '), 200) message from documents""")
def message_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", geometry.sanitised(F.col("text")).alias("message"))


@query("""select event_type, count(*) n, sum((props->>'$.k')::bigint)::bigint k, count(*) filter (props is null) missing from events group by event_type""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k"), F.count_if(F.col("props").isNull()).alias("missing"))


@query("""with v as (select s_nationkey, s_suppkey, (s_suppkey * 37 % 101)::double x, s_acctbal / 100 y from supplier),
 n as (select *, coalesce(lead(x) over w, first(x) over w) x2, coalesce(lead(y) over w, first(y) over w) y2 from v window w as (partition by s_nationkey order by s_suppkey))
 select s_nationkey, count(*) n, round(sum(x * y2 - x2 * y) / 2, 6) area, round(sum(sqrt((x2 - x) ** 2 + (y2 - y) ** 2)), 6) perimeter from n group by s_nationkey""")
def polygon_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed area and perimeter of rings of vertices."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    v = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", (F.col("s_suppkey") * 37 % 101).cast("double").alias("x"), (F.col("s_acctbal") / 100).alias("y"))
    v = v.select("s_nationkey", "x", "y", *[F.coalesce(F.lead(a).over(w), F.first(a).over(w)).alias(f"{a}2") for a in "xy"])
    edge = F.sqrt(F.expr("(x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)"))
    return v.groupBy("s_nationkey").agg(F.count("*").alias("n"), r(F.sum(F.expr("x * y2 - x2 * y")) / 2).alias("area"), r(F.sum(edge)).alias("perimeter"))


CHUNKS = """k as (select l_returnflag session, (l_suppkey % 10)::int stream, (l_orderkey * 10 + l_linenumber) seq, min(epoch_us(l_shipdate)) t, min(l_partkey) p from lineitem group by all),
 b as (select *, case when seq % 2003 = 0 then 'mismatch' when seq % 3001 = 0 then 'truncated' else 'ok' end own from k), f as (select *, min(case when own <> 'ok' then seq end) over (partition by session, stream) bad from b)"""


def chunk_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of ten streams a session, some with a wrong checksum or cut short."""
    k = table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_returnflag").alias("session"), (F.col("l_suppkey") % 10).cast("int").alias("stream"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq")
    ).agg(F.min(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', l_shipdate)")).alias("t"), F.min("l_partkey").alias("p"))
    whole = F.encode(F.format_string("chunk %d of %d", F.col("seq"), F.col("p")), "UTF-8")
    k = k.withColumn("whole", whole).withColumn("crc32", F.crc32("whole")).withColumn("size", F.octet_length("whole"))
    wrong, short = F.col("seq") % 2003 == 0, F.col("seq") % 3001 == 0
    broken = F.concat(F.substring("whole", 1, 3), F.encode(F.lit("?"), "UTF-8"), F.expr("substring(whole, 5)"))
    payload = F.when(wrong, broken).when(short, F.substring("whole", 1, 9)).otherwise(F.col("whole"))
    return k.withColumn("payload", payload).drop("whole", "p")


@query(f"""with {CHUNKS} select session, stream, count(*) chunks, min(t) t_first, max(t) t_last from f where bad is null or seq < bad group by all""")
def chunk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of each stream before its first bad one, summed up."""
    return packets.stream_summary(packets.valid_prefix(chunk_log(spark, sf_dir))).drop("bytes")


@query(f"""with {CHUNKS} select session, case when seq > bad then 'after_bad' else own end state, count(*) n from f group by all""")
def chunk_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets.chunk_states(chunk_log(spark, sf_dir)).groupBy("session", "state").agg(F.count("*").alias("n"))
