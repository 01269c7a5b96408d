"""Registered queries on fits, views, colours, rings and walls, each with its oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sweepline.functions import geometry
from sweepline.operators import fits, ordered
from sweepline.plans.bindings import CLOUD, TRACK, cloud, track
from sweepline.plans.queries import HOUR, query, r
from sweepline.session import table

PAIRS = """pairs as (select l_suppkey session, l_quantity x, l_discount * 300 y, 0.5 + (l_partkey % 3) / 4.0::double sigma, 100 + 1.5 * (0.8 * l_quantity - 0.6 * l_discount * 300) + (l_orderkey % 7 - 3) * 0.1 + case when l_orderkey % 50 = 0 then 20 else 0 end e,
 -30 + 1.5 * (0.6 * l_quantity + 0.8 * l_discount * 300) + (l_orderkey % 5 - 2) * 0.1 n from lineitem)"""


def _round(k: int) -> str:
    w = "1 / (sigma * sigma)" if k == 0 else "case when res <= 1.5 * sigma then 1 else 1.5 * sigma / res end / (sigma * sigma)"
    src = "pairs" if k == 0 else f"r{k - 1}"
    return f"""m{k} as (select session, sum({w} * x) / sum({w}) mx, sum({w} * y) / sum({w}) my, sum({w} * e) / sum({w}) me, sum({w} * n) / sum({w}) mn from {src} group by session),
 q{k} as (select session, any_value(mx) mx, any_value(my) my, any_value(me) me, any_value(mn) mn, sum({w} * ((x - mx) * (e - me) + (y - my) * (n - mn))) d, sum({w} * ((x - mx) * (n - mn) - (y - my) * (e - me))) c, sum({w} * ((x - mx) ** 2 + (y - my) ** 2)) xx, count(*) k from {src} join m{k} using (session) group by session),
 f{k} as (select session, d / sqrt(d * d + c * c) co, c / sqrt(d * d + c * c) si, sqrt(d * d + c * c) / xx sc, mx, my, me, mn, k from q{k}), g{k} as (select *, me - sc * (co * mx - si * my) e0, mn - sc * (si * mx + co * my) n0 from f{k}),
 r{k} as (select p.*, sqrt((e - e0 - sc * (co * x - si * y)) ** 2 + (n - n0 - sc * (si * x + co * y)) ** 2) res from pairs p join g{k} using (session))"""


@query(f"""with {PAIRS}, {_round(0)}, {_round(1)}, {_round(2)}, z as (select session, sqrt(avg(res * res)) rms from r2 group by session)
 select session, k pairs, round(degrees(atan2(si, co)), 4) yaw, round(sc, 5) scale, round(e0, 3) e0, round(n0, 3) n0, round(rms, 4) rms from g2 join z using (session)""")
def weighted_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarities of all sessions at once, outliers weighted down over three rounds."""
    t = table(spark, sf_dir, "lineitem")
    x, y, o = F.col("l_quantity"), F.col("l_discount") * 300, F.col("l_orderkey")
    pairs = t.select(
        F.col("l_suppkey").alias("session"), x.alias("x"), y.alias("y"), (0.5 + F.col("l_partkey") % 3 / 4.0).alias("sigma"),
        (100 + 1.5 * (0.8 * x - 0.6 * y) + (o % 7 - 3) * 0.1 + F.when(o % 50 == 0, 20).otherwise(0)).alias("e"), (-30 + 1.5 * (0.6 * x + 0.8 * y) + (o % 5 - 2) * 0.1).alias("n"),
    )
    s = fits.similarity(pairs, "session")
    return s.select("session", "pairs", r(F.degrees(F.atan2("s", "c")), 4).alias("yaw"), r("scale", 5).alias("scale"), r("e0", 3).alias("e0"), r("n0", 3).alias("n0"), r("rms", 4).alias("rms"))


AXES = (("y * nz - z * ny"), ("z * nx - x * nz"), ("x * ny - y * nx"), "nx", "ny", "nz")


@query(f"""with {CLOUD}, m as (select session, x, y, z, case when l_partkey % 2 = 0 then 0.6 else 0 end nx, case when l_partkey % 2 = 1 then 1 else 0 end ny, case when l_partkey % 2 = 0 then 0.8 else 0 end nz, x + 0.1 tx, y - 0.2 ty, z + (l_suppkey % 5) * 0.1 tz from cloud),
 b as (select *, nx * (tx - x) + ny * (ty - y) + nz * (tz - z) b from m), w as (select *, case when abs(b) <= 0.2 then 1 else 0.2 / abs(b) end w from b)
 select session, count(*) n, round(sqrt(avg(b * b)), 8) rms, {', '.join(f"round(sum(w * ({AXES[i]}) * ({AXES[j]})), 2) s{i}{j}" for i in range(6) for j in range(i, 6))}, {', '.join(f"round(sum(w * ({AXES[i]}) * b), 2) b{i}" for i in range(6))} from w group by session""")
def icp_normal_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sums of one point-to-plane step of each session; the solve is 6 x 6."""
    even = F.col("l_partkey") % 2 == 0
    m = cloud(spark, sf_dir).select(
        "session", "x", "y", "z", F.when(even, 0.6).otherwise(0.0).alias("nx"), F.when(even, 0.0).otherwise(1.0).alias("ny"), F.when(even, 0.8).otherwise(0.0).alias("nz"),
        (F.col("x") + 0.1).alias("tx"), (F.col("y") - 0.2).alias("ty"), (F.col("z") + F.col("l_suppkey") % 5 * 0.1).alias("tz"),
    )
    e = fits.plane_equations(m, ["session"], 0.2)
    return e.select("session", "n", r("rms", 8).alias("rms"), *[r(c, 2).alias(c) for c in e.columns if c[0] in "sb" and c[1:].isdigit()])


@query(f"""with {TRACK}, t as (select user_id, t // {24 * HOUR} k, list_sort(list(value)) v, count(*) filter (event_id % 60 = 0) bad, count(*) n from track group by all),
 e as (select *, case when n >= 2 then v[floor(0.95 * (n - 1))::int + 1] - v[floor(0.05 * (n - 1))::int + 1] end extent from t), s as (select user_id, count(extent) turns, median(extent) extent, sum(bad) / sum(n)::double impossible from e group by user_id)
 select user_id, turns, round(extent, 6) extent, round(impossible, 8) impossible, case when turns < 5 then 'too_few' when impossible > 0.02 then 'mismatch' when extent > 60 then 'suspect' else 'ok' end verdict from s""")
def mount_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = fits.mount_watch(track(spark, sf_dir), "user_id", "t", 24 * HOUR, "value", F.col("event_id") % 60 == 0, least=2, least_turns=5, most_extent=60)
    return w.select("user_id", "turns", r("extent").alias("extent"), r("impossible", 8).alias("impossible"), "verdict")


@query("""with n as (select o_orderkey, o_custkey, row_number() over (order by o_orderkey, o_custkey, o_totalprice) - 1 nth, greatest(1, ceil(count(*) over () / 400.0))::bigint step from orders) select o_orderkey, o_custkey from n where nth % step = 0""")
def stride_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fits.strided(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"], 400, F.expr("o_orderkey div 1000")).select("o_orderkey", "o_custkey")


@query(f"""with {CLOUD}, c as (select distinct l_suppkey s, floor(x * 0.2)::bigint i, floor(y * (1 / 5.0))::bigint j, floor(z * 0.2)::bigint k from cloud), n as (select s, count(*) n from c group by s)
 select a.s a, b.s b, count(*) shared, round(count(*) / greatest(any_value(na.n), any_value(nb.n))::double, 9) overlap from c a join c b using (i, j, k) join n na on na.s = a.s join n nb on nb.s = b.s where a.s < b.s group by all""")
def session_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of their voxels each two sessions share."""
    s = fits.overlap_survey(cloud(spark, sf_dir).select(F.col("l_suppkey").alias("session"), "x", "y", "z"), "session", 5.0)
    return s.withColumn("overlap", r("overlap", 9))


@query("""with h as (select l_partkey point, l_linenumber::int frame, l_quantity * 20 u, l_extendedprice / 100 v, 1 + l_discount * 50 depth, cos(radians(l_orderkey % 100)) cosine, 1 - l_tax motion, l_suppkey colour, l_orderkey from lineitem),
 d as (select *, min(depth) over (partition by frame, floor(u / 50), floor(v / 50)) near from h), s as (select *, cosine * (2.0 / (2.0 + depth)) * motion * motion score from d where depth <= near + 1.5 and cosine > 0),
 k as (select *, row_number() over (partition by point order by round(score, 12) desc, frame) rn, count(*) over (partition by point) views from s) select point, round(max(score), 8) score, max(views) views from k group by point""")
def best_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best visible view of each point."""
    h = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("point"), F.col("l_linenumber").cast("int").alias("frame"), (F.col("l_quantity") * 20).alias("u"), (F.col("l_extendedprice") / 100).alias("v"), (1 + F.col("l_discount") * 50).alias("depth"),
        F.cos(F.radians(F.col("l_orderkey") % 100)).alias("cosine"), (1 - F.col("l_tax")).alias("motion"), F.col("l_suppkey").alias("colour"),
    )
    return fits.best_views(h, "point", "frame", 50, 1.5, 2.0).select("point", r("score", 8).alias("score"), "views")


F_C, CENTRE, DISTORTION = (900.0, 905.0), (640.0, 360.0), (0.08, -0.02, 0.001, -0.0005, 0.003)


@query("""with p as (select s_suppkey, (s_suppkey % 13 - 6) / 5.0::double x, (s_suppkey % 7 - 3) / 5.0::double y, 2 + (s_suppkey % 5)::double z from supplier), a as (select *, x / z a, y / z b, (x / z) ** 2 + (y / z) ** 2 r2 from p), d as (select *, 1 + r2 * (0.08 + r2 * (-0.02 + r2 * 0.003)) k from a)
 select s_suppkey, round(900 * (a * k + 2 * 0.001 * a * b + -0.0005 * (r2 + 2 * a * a)) + 640, 6) u, round(905 * (b * k + 0.001 * (r2 + 2 * b * b) + 2 * -0.0005 * a * b) + 360, 6) v from d""")
def camera_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    u, v = fits.projected((k % 13 - 6) / 5.0, (k % 7 - 3) / 5.0, (2 + k % 5).cast("double"), F_C, CENTRE, DISTORTION)
    return table(spark, sf_dir, "supplier").select("s_suppkey", r(u).alias("u"), r(v).alias("v"))


STOPS = ((0, 0, 128), (0, 200, 255), (255, 240, 0), (200, 0, 0))


@query(f"""with t as (select p_partkey, least(1, greatest(0, (p_retailprice - 950) / 500)) t from part), a as (select *, floor(t * 255) / 255 * 3 w from t), b as (select *, least(floor(w), 2)::int l from a), s as (select *, w - l m, [[0, 0, 128], [0, 200, 255], [255, 240, 0], [200, 0, 0]] c from b)
 select p_partkey, {', '.join(f"floor(c[l + 1][{i}] * (1 - m) + c[l + 2][{i}] * m + 0.5)::int {n}" for i, n in ((1, 'r'), (2, 'g'), (3, 'b')))} from s""")
def colormap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fits.colour_of(geometry.scalar_of(F.col("p_retailprice"), 950, 1450), STOPS)
    return table(spark, sf_dir, "part").select("p_partkey", c.alias("c")).select("p_partkey", "c.*")


RING = """v as (select s_nationkey ring, s_suppkey, (s_suppkey * 37 % 101)::double x, s_acctbal / 100 y from supplier), e as (select *, coalesce(lead(x) over w, first(x) over w) x2, coalesce(lead(y) over w, first(y) over w) y2 from v window w as (partition by ring order by s_suppkey))"""


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("ring"), "s_suppkey", (F.col("s_suppkey") * 37 % 101).cast("double").alias("x"), (F.col("s_acctbal") / 100).alias("y"))


@query(f"""with {RING}, m as (select ring, sum(x * y2 - x2 * y) c, sum((x + x2) * (x * y2 - x2 * y)) sx, sum((y + y2) * (x * y2 - x2 * y)) sy, sum(sqrt((x2 - x) ** 2 + (y2 - y) ** 2)) p, min(x) min_x, min(y) min_y, max(x) max_x, max(y) max_y from e group by ring)
 select ring, round(c / 2, 5) area, round(p, 5) perimeter, round(case when abs(c) > 1e-6 then sx / (3 * c) end, 3) cx, round(case when abs(c) > 1e-6 then sy / (3 * c) end, 3) cy, min_x, min_y, max_x, max_y from m""")
def ring_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fits.ring_measures(rings(spark, sf_dir), "ring", ["s_suppkey"])
    real = F.abs("area") > 5e-7
    return m.select("ring", r("area", 5).alias("area"), r("perimeter", 5).alias("perimeter"), *[F.when(real, r(c, 3)).alias(c) for c in ("cx", "cy")], "min_x", "min_y", "max_x", "max_y")


@query(f"""with {RING}, p as (select c_custkey, c_nationkey ring, (c_custkey % 100) + 0.5::double x, (c_custkey * 7 % 110 - 10) + 0.25::double y from customer)
 select c_custkey, (select count(*) from e where e.ring = p.ring and (e.y > p.y) <> (e.y2 > p.y) and p.x < (e.x2 - e.x) * (p.y - e.y) / (e.y2 - e.y) + e.x) % 2 = 1 inside from p where ring in (select ring from v)""")
def points_in_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("ring"), (F.col("c_custkey") % 100 + 0.5).alias("x"), (F.col("c_custkey") * 7 % 110 - 10 + 0.25).alias("y"))
    return fits.inside_rings(p, rings(spark, sf_dir), "ring", ["s_suppkey"]).select("c_custkey", "inside")


@query("""with w as (select o_orderkey wall, 0.0::double lo, 60.0::double hi from orders), o as (select l_orderkey wall, min(l_quantity) lo, min(l_quantity) + 3 hi from lineitem group by l_orderkey, l_linenumber), g as (select wall, lo, hi, max(hi) over (partition by wall order by lo, hi rows between unbounded preceding and 1 preceding) reach from o),
 p as (select wall, coalesce(reach, 0) lo, lo hi from g where lo > coalesce(reach, 0) union all select w.wall, coalesce(max(o.hi), 0), 60 from w left join o using (wall) group by w.wall) select wall, count(*) pieces, round(sum(hi - lo), 6) length from p where lo < hi group by wall""")
def wall_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What openings leave of walls."""
    w = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("wall"), F.lit(0.0).alias("lo"), F.lit(60.0).alias("hi"))
    o = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("wall"), "l_linenumber").agg(F.min("l_quantity").alias("lo")).select("wall", "lo", (F.col("lo") + 3).alias("hi"))
    return fits.without_openings(w, o, "wall").groupBy("wall").agg(F.count("*").alias("pieces"), r(F.sum(F.col("hi") - F.col("lo"))).alias("length"))


@query("""with a as (select l_suppkey s, epoch_us(l_shipdate) // 86400000000 lo, epoch_us(l_shipdate) // 86400000000 + 2 hi from lineitem where l_linenumber = 1), b as (select l_suppkey s, epoch_us(l_shipdate) // 86400000000 lo, epoch_us(l_shipdate) // 86400000000 + 3 hi from lineitem where l_linenumber = 2),
 x as (select distinct s, unnest(range(lo, hi)) d from a), y as (select distinct s, unnest(range(lo, hi)) d from b) select s, count(*) overlap from x join y using (s, d) group by s""")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that both of two lists of intervals cover."""
    day = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', l_shipdate) div 86400000000")
    t = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), "l_linenumber", day.alias("lo"))
    of = lambda n: ordered.merged_intervals(t.where(F.col("l_linenumber") == n).select("s", "lo", (F.col("lo") + n + 1).alias("hi")), ["s"], 0, F.expr("lo div 100")).select("s", "lo", "hi")
    return ordered.interval_overlap(of(1), of(2), ["s"], F.expr("at div 100"))


@query("""with n as (select c_custkey, c_acctbal v from customer), t as (select *, printf('%.3f', v) s from n) select c_custkey, case when regexp_replace(regexp_replace(s, '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') = '-0' then '0' else regexp_replace(regexp_replace(s, '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') end shown from t""")
def number_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", fits.trimmed_number(F.col("c_acctbal"), 3).alias("shown"))


@query("""select l_orderkey, count(*) outliers from lineitem where not exists (select 1 from orders where o_orderkey = l_orderkey and o_orderstatus = 'F') group by l_orderkey""")
def inlier_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a set of inliers leaves."""
    inliers = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").join(inliers, "l_orderkey", "left_anti").groupBy("l_orderkey").agg(F.count("*").alias("outliers"))
