"""Registered queries on geodesy, NMEA sentences, fixes and correction frames, each with its oracle SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sweepline.functions import geodesy, nmea
from sweepline.operators import asof, gnss
from sweepline.plans.bindings import TRACK, track
from sweepline.plans.queries import GEO, HOUR, N, geo, query, r
from sweepline.session import table
from sweepline.sources import rtcm


def sum_sql(series: tuple, form: str) -> str:
    return " + ".join(form.format(j2=2 * j, f=repr(f)) for j, f in enumerate(geodesy.terms(series), 1))


ZONE = """case when lat >= 56 and lat < 64 and lon >= 3 and lon < 12 then 32 when lat >= 72 and lat < 84 and lon >= 0 and lon < 9 then 31
 when lat >= 72 and lat < 84 and lon >= 9 and lon < 21 then 33 when lat >= 72 and lat < 84 and lon >= 21 and lon < 33 then 35 when lat >= 72 and lat < 84 and lon >= 33 and lon < 42 then 37
 else (floor((lon + 180) / 6)::int % 60) + 1 end"""


@query(f"""with {GEO}, z as (select c_custkey, lat, radians(lat) p, {ZONE} zone, radians(lon - ({ZONE} * 6 - 183)) dl from geo),
 t as (select *, sinh(atanh(sin(p)) - {geodesy.E!r} * atanh({geodesy.E!r} * sin(p))) t, cos(dl) c from z),
 u as (select *, sqrt(t * t + c * c) hyp, atan2(t, c) xi, asinh(sin(dl) / sqrt(t * t + c * c)) eta from t),
 s as (select *, xi + {sum_sql(geodesy.FORWARD, "{f} * sin({j2} * xi) * cosh({j2} * eta)")} north, eta + {sum_sql(geodesy.FORWARD, "{f} * cos({j2} * xi) * sinh({j2} * eta)")} east,
  1 + {sum_sql(geodesy.FORWARD, "{j2} * {f} * cos({j2} * xi) * cosh({j2} * eta)")} dx, {sum_sql(geodesy.FORWARD, "{j2} * {f} * sin({j2} * xi) * sinh({j2} * eta)")} de from u)
 select c_custkey, round(500000 + {geodesy.K0 * geodesy.RADIUS!r} * east, 3) east, round(case when lat < 0 then 1e7 else 0 end + {geodesy.K0 * geodesy.RADIUS!r} * north, 3) north,
 case when lat < 0 then 32700 else 32600 end + zone epsg, round({geodesy.K0 * geodesy.RADIUS / geodesy.A!r} * sqrt(1 - {geodesy.E2!r} * sin(p) ** 2) / (cos(p) * hyp) * sqrt(dx * dx + de * de), 9) scale,
 round(degrees(atan2(t * tan(dl), sqrt(1 + t * t)) + atan2(de, dx)), 7) convergence from s""")
def utm_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon = F.col("lat"), F.col("lon")
    tm = geodesy.transverse_mercator(lat, lon, geodesy.central_meridian(geodesy.utm_zone(lat, lon)))
    east, north = geodesy.to_utm(lat, lon)
    return geo(spark, sf_dir).select(
        "c_custkey", r(east, 3).alias("east"), r(north, 3).alias("north"), geodesy.epsg(lat, lon).alias("epsg"),
        r(tm["k"], 9).alias("scale"), r(tm["gamma"], 7).alias("convergence"),
    )


@query(f"with {GEO} select c_custkey, round(lat, 9) lat, round(lon, 9) lon from geo")
def utm_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """There and back."""
    lat, lon = F.col("lat"), F.col("lon")
    east, north = geodesy.to_utm(lat, lon)
    there = geo(spark, sf_dir).select("c_custkey", east.alias("e"), north.alias("n"), geodesy.utm_zone(lat, lon).alias("zone"), (lat < 0).alias("south"))
    lat, lon = geodesy.from_utm(F.col("e"), F.col("n"), F.col("zone"), F.col("south"))
    return there.select("c_custkey", r(lat, 9).alias("lat"), F.when(r(lon, 9) == 180, -180.0).otherwise(r(lon, 9)).alias("lon"))


ORIGIN = (48.0, 11.5, 520.0)


@query(f"""with {GEO}, x as (select c_custkey, lat, ({N} + h) * cos(radians(lat)) * cos(radians(lon)) x, ({N} + h) * cos(radians(lat)) * sin(radians(lon)) y, ({N} * (1 - {geodesy.E2!r}) + h) * sin(radians(lat)) z from geo),
 o as (select 48.0 lat, 11.5 lon, 520.0 h), f as (select ({N} + h) * cos(radians(lat)) * cos(radians(lon)) ox, ({N} + h) * cos(radians(lat)) * sin(radians(lon)) oy, ({N} * (1 - {geodesy.E2!r}) + h) * sin(radians(lat)) oz,
  sin(radians(lat)) sp, cos(radians(lat)) cp, sin(radians(lon)) sl, cos(radians(lon)) cl from o)
 select c_custkey, round(-sl * (x - ox) + cl * (y - oy), 3) e, round(-sp * (cl * (x - ox) + sl * (y - oy)) + cp * (z - oz), 3) n, round(cp * (cl * (x - ox) + sl * (y - oy)) + sp * (z - oz), 3) u,
 round(x, 3) back_x, round(y, 3) back_y, round(z, 3) back_z, round(pi() / 180 * {geodesy.A * (1 - geodesy.E2)!r} / sqrt(1 - {geodesy.E2!r} * sin(radians(lat)) ** 2) ** 3, 3) lat_metres,
 round(pi() / 180 * {geodesy.A} / sqrt(1 - {geodesy.E2!r} * sin(radians(lat)) ** 2) * cos(radians(lat)), 3) lon_metres from x, f""")
def enu_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = geo(spark, sf_dir).select("c_custkey", "lat", *[c.alias(a) for a, c in zip("xyz", geodesy.to_ecef(F.col("lat"), F.col("lon"), F.col("h")), strict=True)])
    local = g.select("c_custkey", "lat", *[c.alias(a) for a, c in zip("enu", geodesy.to_enu(F.col("x"), F.col("y"), F.col("z"), *ORIGIN), strict=True)])
    back = geodesy.from_enu(F.col("e"), F.col("n"), F.col("u"), *ORIGIN)
    metres = geodesy.metres_per_degree(F.col("lat"))
    return local.select(
        "c_custkey", *[r(a, 3).alias(a) for a in "enu"], *[r(c, 3).alias(f"back_{a}") for a, c in zip("xyz", back, strict=True)],
        r(metres[0], 3).alias("lat_metres"), r(metres[1], 3).alias("lon_metres"),
    )


@query(f"""with {GEO}, z as (select *, {ZONE} zone from geo) select c_custkey, '+proj=utm +zone=' || zone || case when lat < 0 then ' +south' else '' end || ' +datum=WGS84 +units=m +no_defs' proj,
 'WGS 84 / UTM zone ' || zone || case when lat < 0 then 'S' else 'N' end wkt_name from z""")
def crs_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon = F.col("lat"), F.col("lon")
    return geo(spark, sf_dir).select("c_custkey", geodesy.proj_string(lat, lon).alias("proj"), geodesy.wkt_name(lat, lon).alias("wkt_name"))


@query(f"""with {GEO}, z as (select c_custkey, lat, lon, radians(lat - 48.0) dp, radians(lon - 11.5) dl from geo),
 h as (select *, sin(dp / 2) ** 2 + cos(radians(48.0)) * cos(radians(lat)) * sin(dl / 2) ** 2 h from z)
 select c_custkey, 'MP' || c_custkey mount, 'RTCM 3.2' format, round(lat, 3) lat, round(lon, 3) lon, round(12742000 * asin(sqrt(least(1, h))), 0) metres from
  (select c_custkey, round(lat, 3) lat, round(lon, 3) lon, sin(radians(round(lat, 3) - 48.0) / 2) ** 2 + cos(radians(48.0)) * cos(radians(round(lat, 3))) * sin(radians(round(lon, 3) - 11.5) / 2) ** 2 h from h)""")
def sourcetable_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of a caster's source table, with their distance from the origin."""
    k = F.col("c_custkey").cast("string")
    line = F.concat(F.lit("STR;MP"), k, F.lit(";Town;RTCM 3.2;1004(1);2;GPS;NET;DEU;"), F.format_string("%.3f;%.3f", F.round("lat", 3), F.round("lon", 3)), F.lit(";1;0;caster;none;B;N;9600;"))
    part = lambda i: F.split("line", ";")[i]
    rows = geo(spark, sf_dir).select("c_custkey", line.alias("line")).where(F.col("line").startswith("STR;"))
    rows = rows.select("c_custkey", part(1).alias("mount"), part(3).alias("format"), part(9).cast("double").alias("lat"), part(10).cast("double").alias("lon"))
    return rows.withColumn("metres", r(geodesy.great_circle(F.lit(ORIGIN[0]), F.lit(ORIGIN[1]), F.col("lat"), F.col("lon")), 0))


# ---- sentences -----------------------------------------------------------------------------------------------


def gga_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GGA sentences of events, every tenth with a wrong checksum."""
    k = F.col("event_id")
    said = F.format_string(
        "GPGGA,%02d%02d%02d.00,%02d%02d.%02d00,%s,%03d%02d.%02d00,E,%d,08,1.0,%d.5,M,0.0,M,,",
        k % 24, k % 60, k * 7 % 60, k % 90, k % 60, k % 100, F.when(k % 2 == 0, "N").otherwise("S"), k % 180, k % 59, k % 97, k % 7, k % 500,
    )
    whole = table(spark, sf_dir, "events").select("event_id", said.alias("body")).select("event_id", nmea.framed(F.col("body")).alias("w"))
    broken = F.concat(F.expr("substring(w, 1, length(w) - 2)"), F.when(F.expr("right(w, 2)") == "00", "01").otherwise("00"))
    return whole.select("event_id", F.when(k % 10 == 0, broken).otherwise(F.col("w")).alias("line"))


@query("""select event_id, case when event_id % 10 = 0 then 'bad_checksum' else 'ok' end status, case when event_id % 10 > 0 then case event_id % 7 when 1 then 'single' when 2 then 'dgps' when 3 then 'single' when 4 then 'rtk_fixed' when 5 then 'rtk_float' else 'none' end end fix,
 case when event_id % 10 > 0 then round(((event_id % 90) + ((event_id % 60) + (event_id % 100) / 100.0) / 60) * (case when event_id % 2 = 0 then 1 else -1 end), 7) end lat,
 case when event_id % 10 > 0 then round((event_id % 180) + ((event_id % 59) + (event_id % 97) / 100.0) / 60, 7) end lon,
 case when event_id % 10 > 0 then ((event_id % 24) * 3600 + (event_id % 60) * 60 + event_id * 7 % 60)::double end sod, case when event_id % 10 > 0 then (event_id % 500) + 0.5::double end alt from events""")
def nmea_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sentences: broken ones keep their status and have no fields."""
    parsed = nmea.parsed(gga_lines(spark, sf_dir))
    g = nmea.gga()
    of = lambda c: F.when(F.col("status") == "ok", c)
    return parsed.select("event_id", "status", of(g["fix"]).alias("fix"), of(r(g["lat"], 7)).alias("lat"), of(r(g["lon"], 7)).alias("lon"), of(g["sod"]).alias("sod"), of(g["alt"]).alias("alt"))


FAULTY = ("ok", *nmea.FAULTS)


@query(f"""select case event_id % {len(FAULTY)} {' '.join(f"when {i} then '{s}'" for i, s in enumerate(FAULTY))} end status, count(*) n from events group by all""")
def nmea_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of each class of faults."""
    k = F.col("event_id") % len(FAULTY)
    good = nmea.framed(F.concat(F.lit("GPTXT,01,"), F.col("event_id").cast("string")))
    lines = {
        "empty": F.lit(""), "too_long": F.concat(good, F.repeat(F.lit("x"), 300)), "no_start": F.expr("substring(good, 2)"), "too_short": F.lit("$GPGG*00"),
        "bad_character": F.lit("$GPTXT,a\u0007b*00"), "bad_checksum_hex": F.lit("$GPTXT,1*G1"), "no_checksum": F.lit("$GPTXT,1"),
        "too_many_fields": nmea.framed(F.concat(F.lit("GPTXT"), F.repeat(F.lit(","), 41))), "bad_checksum": F.regexp_replace("good", "GPTXT,01", "GPTXT,02"),
    }
    line = F.col("good")
    for i, name in enumerate(FAULTY[1:], 1):
        line = F.when(k == i, lines[name]).otherwise(line)
    return nmea.parsed(table(spark, sf_dir, "events").select("event_id", good.alias("good")).select(line.alias("line"))).groupBy("status").agg(F.count("*").alias("n"))


def bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five events make a burst of GGA, RMC, GST, GSA and VTG; every third has no place in its GGA, every fourth no GST, every seventh no RMC; a session has 20 bursts."""
    k, b = F.col("event_id"), F.expr("event_id div 5")
    time = F.format_string("%02d%02d%02d.00", b % 24, b % 60, b * 7 % 60)
    place = F.format_string("%02d%02d.5000,N,%03d%02d.2500,W", b % 80, b % 60, b % 180, b % 59)
    said = (
        F.when(k % 5 == 0, F.concat(F.lit("GNGGA,"), time, F.lit(","), F.when(b % 3 == 0, ",,,").otherwise(place), F.format_string(",%d,11,%d.5,100.0,M,47.0,M,,", b % 9, b % 7)))
        .when((k % 5 == 1) & (b % 7 > 0), F.concat(F.lit("GNRMC,"), time, F.when(b % 2 == 0, ",A,").otherwise(",V,"), place, F.format_string(",%d.0,90.0,%02d0224,,,%s", b % 30, b % 28 + 1, F.expr("substring('ADRFN', cast(event_id div 5 % 5 + 1 as int), 1)"))))
        .when((k % 5 == 2) & (b % 4 > 0), F.concat(F.lit("GNGST,"), time, F.format_string(",1.0,3.0,2.0,45.0,0.%d,0.%d,0.9", b % 9 + 1, b % 8 + 1)))
        .when(k % 5 == 3, F.lit("GNGSA,A,3,01,02,03,,,,,,,,,,2.5,1.5,2.0"))
        .when(k % 5 == 4, F.format_string("GNVTG,45.0,T,,M,%d.0,N,,K,A", b % 40))
        .otherwise(F.lit("GNTXT,nothing"))
    )
    rows = table(spark, sf_dir, "events").select("event_id", said.alias("body")).select(F.expr("event_id div 100").alias("session"), F.col("event_id").alias("seq"), nmea.framed(F.col("body")).alias("line"))
    return nmea.decoded(nmea.parsed(rows))


@query("""with k as (select event_id, event_id // 5 b from events) select event_id, case event_id % 5 when 0 then 'GGA' when 1 then 'RMC' when 2 then 'GST' when 3 then 'GSA' else 'VTG' end kind,
 case when event_id % 5 < 3 then ((b % 24) * 3600 + (b % 60) * 60 + b * 7 % 60)::double end sod,
 case event_id % 5 when 1 then (b % 30)::double when 4 then (b % 40)::double end knots, case event_id % 5 when 4 then round((b % 40) * 1.852, 6) end kmh,
 case when event_id % 5 = 1 then make_date(2024, 2, (b % 28 + 1)::int)::varchar end date, case when event_id % 5 = 2 then (b % 9 + 1) / 10.0::double end lat_sigma,
 case when event_id % 5 = 3 then 3 end used, case when event_id % 5 = 3 then 2.5::double end pdop from k where not (event_id % 5 = 1 and b % 7 = 0) and not (event_id % 5 = 2 and b % 4 = 0)""")
def fix_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed fields of each kind of sentence."""
    return bursts(spark, sf_dir).select(
        F.col("seq").alias("event_id"), "kind", F.coalesce("gga.sod", "rmc.sod", "gst.sod").alias("sod"), F.coalesce("rmc.knots", "vtg.knots").alias("knots"), r("vtg.kmh").alias("kmh"),
        F.col("rmc.date").cast("string").alias("date"), F.col("gst.lat_sigma").alias("lat_sigma"), F.col("gsa.satellites_used").alias("used"), F.col("gsa.pdop").alias("pdop"),
    )


@query(f"""with b as (select distinct event_id // 100 session, event_id // 5 b from events), f as (select *, b % 3 > 0 gga, b % 7 > 0 and b % 2 = 0 rmc, b % 4 > 0 gst from b),
 g as (select *, case when gga then case b % 9 when 1 then 'single' when 2 then 'dgps' when 3 then 'single' when 4 then 'rtk_fixed' when 5 then 'rtk_float' when 8 then 'single' else 'none' end
  when rmc then case b % 5 when 0 then 'single' when 1 then 'dgps' when 2 then 'rtk_fixed' when 3 then 'rtk_float' else 'none' end else 'none' end fix, (b % 7) + 0.5 hdop from f),
 s as (select *, case fix {' '.join(f"when '{k}' then {v[0]}" for k, v in nmea.FIXES.items())} end * greatest(0.5, least(5, hdop)) plain from g),
 o as (select session, b, (b % 24) * 3600 + (b % 60) * 60 + b * 7 % 60 sod, case when b % 7 > 0 then make_date(2024, 2, (b % 28 + 1)::int) end own from f), c as (select *, sod + 43200 < lag(sod) over (partition by session order by b) and own is null fell from o),
 n as (select *, count(*) filter (fell) over (partition by session order by b rows unbounded preceding) gone from c), t as (select session, b, sod, gone - last_value(case when own is not null then gone end ignore nulls) over w since, last_value(own ignore nulls) over w held from n window w as (partition by session order by b rows unbounded preceding))
 select session, b - min(b) over (partition by session) epoch, fix, round(case when gga or rmc then (b % 80) + ((b % 60) + 0.5) / 60 end, 7) lat, round(case when gga or rmc then -((b % 180) + ((b % 59) + 0.25) / 60) end, 7) lon,
 case when gga then 147.0 else 0.0 end::double height, round((case when b % 7 > 0 then b % 30 else b % 40 end) * 0.514444444, 6) speed, case when b % 7 > 0 then 90.0 else 45.0 end::double course,
 round(case when gst then (b % 9 + 1) / 10.0 else plain end, 6) sigma_north, round(case when gst then (b % 8 + 1) / 10.0 else plain end, 6) sigma_east, round(case when gst then 0.9 else plain * 1.6 end, 6) sigma_up, gst sigma_from_gst,
 epoch_us((held + since::int)::timestamp) * 1000 + sod * 1000000000::bigint utc_ns from s join t using (session, b)""")
def epoch_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fix for each burst; a date holds until the next, over midnight."""
    e = gnss.epochs(bursts(spark, sf_dir), ["session"], ["seq"], F.expr("seq div 25"))
    return e.select(
        "session", "epoch", "fix", r("lat", 7).alias("lat"), r("lon", 7).alias("lon"), "height", r("speed").alias("speed"), "course",
        *[r(f"sigma_{a}").alias(f"sigma_{a}") for a in ("north", "east", "up")], "sigma_from_gst", "utc_ns",
    )


@query(f"""with f as (select c_custkey, c_custkey % 10 q, substring('ADRFPSEMNx', (c_custkey % 10 + 1)::int, 1) m from customer),
 g as (select *, case q {' '.join(f"when {k} then '{v}'" for k, v in nmea.GGA_FIX.items())} else 'none' end a, case m {' '.join(f"when '{k}' then '{v}'" for k, v in nmea.MODE_FIX.items())} else 'none' end b from f)
 select a gga_fix, b rmc_fix, count(*) n, min(case a {' '.join(f"when '{k}' then {v[0]}" for k, v in nmea.FIXES.items())} end)::double sigma, min(case b {' '.join(f"when '{k}' then '{v[1]}'" for k, v in nmea.FIXES.items())} end) quality,
 min(case b {' '.join(f"when '{k}' then {v[2]}" for k, v in nmea.FIXES.items())} end)::double confidence, bool_and(a in ('rtk_float', 'rtk_fixed')) at_least_float,
 min(case when a in ('rtk_float', 'rtk_fixed') then a when b <> 'none' then b else a end) chosen from g group by all""")
def fix_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes of quality digits and mode characters, their ranks, and the policy: the receiver's from float up, else the phone's."""
    q, m = (F.col("c_custkey") % 10).cast("int"), F.expr("substring('ADRFPSEMNx', cast(c_custkey % 10 + 1 as int), 1)")
    rows = table(spark, sf_dir, "customer").select(nmea.fix_of(q).alias("gga_fix"), nmea.fix_of_mode(m).alias("rmc_fix"))
    good = nmea.rank_of(F.col("gga_fix")) >= 3
    chosen = F.when(good, F.col("gga_fix")).when(F.col("rmc_fix") != "none", F.col("rmc_fix")).otherwise(F.col("gga_fix"))
    return rows.groupBy("gga_fix", "rmc_fix").agg(
        F.count("*").alias("n"), F.min(nmea.sigma_of(F.col("gga_fix"))).alias("sigma"), F.min(nmea.quality_of(F.col("rmc_fix"))).alias("quality"),
        F.min(nmea.confidence_of(F.col("rmc_fix"))).alias("confidence"), F.bool_and(good).alias("at_least_float"), F.min(chosen).alias("chosen"),
    )


@query(f"""with {GEO}, b as (select c_custkey, printf('GPGGA,%02d%02d%02d.00,%02d%07.4f,%s,%03d%07.4f,%s,1,08,1.0,%.1f,M,0.0,M,,', c_custkey % 24, c_custkey % 60, c_custkey % 60, floor(abs(lat))::int, round((abs(lat) - floor(abs(lat))) * 60, 4),
  case when lat < 0 then 'S' else 'N' end, floor(abs(lon))::int, round((abs(lon) - floor(abs(lon))) * 60, 4), case when lon < 0 then 'W' else 'E' end, round(h, 1)) body from geo)
 select c_custkey, '$' || body || '*' || printf('%02X', list_reduce(list_transform(string_split(body, ''), lambda c: ascii(c)), lambda a, x: xor(a, x))) line from b""")
def phone_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phone's places as sentences."""
    k = F.col("c_custkey")
    minutes = lambda c: F.round((F.abs(c) - F.floor(F.abs(c))) * 60, 4)
    height = F.round("h", 1)
    signed = F.when((height == 0) & (F.col("h") < 0), -0.0).otherwise(height)  # a height just below 0 keeps its sign, as printf has it
    said = F.format_string(
        "GPGGA,%02d%02d%02d.00,%02d%07.4f,%s,%03d%07.4f,%s,1,08,1.0,%.1f,M,0.0,M,,",
        k % 24, k % 60, k % 60, F.floor(F.abs("lat")), minutes(F.col("lat")), F.when(F.col("lat") < 0, "S").otherwise("N"),
        F.floor(F.abs("lon")), minutes(F.col("lon")), F.when(F.col("lon") < 0, "W").otherwise("E"), signed,
    )
    return geo(spark, sf_dir).select("c_custkey", said.alias("body")).select("c_custkey", nmea.framed(F.col("body")).alias("line"))


@query("""select o_orderkey, epoch_us(o_orderdate::date::timestamp) * 1000 + (o_orderkey % 86400) * 1000000000::bigint + 250000000 ns from orders""")
def utc_civil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nanoseconds of ``ddmmyy`` and seconds of the day."""
    text = F.date_format("o_orderdate", "ddMMyy")
    return table(spark, sf_dir, "orders").select("o_orderkey", nmea.unix_nanos(nmea.date_of(text), F.col("o_orderkey") % 86400 + 0.25).alias("ns"))


# ---- fixes and tracks ----------------------------------------------------------------------------------------


@query(f"""with recursive {TRACK}, f as (select user_id, t, min(event_id) e from track where event_type <> 'error' group by all), n as (select *, row_number() over (partition by user_id order by t) rn from f),
 w as (select user_id, t, rn, t kept from n where rn = 1 union all select n.user_id, n.t, n.rn, case when n.t - w.kept >= {HOUR * 36} then n.t else w.kept end from w join n on n.user_id = w.user_id and n.rn = w.rn + 1)
 select user_id, t from w where t = kept""")
def fix_thinning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes at least a day and a half apart from the last accepted one."""
    f = track(spark, sf_dir).where("event_type <> 'error'").select("user_id", "t").distinct()
    return gnss.thinned(f, ["user_id"], "t", 36 * HOUR, "user_id long, t long")


@query(f"""with {TRACK}, k as (select user_id, t, max(value) as value from track where event_type = 'purchase' group by all), p as (select event_id, user_id, t from track where event_type = 'error'),
 l as (select p.*, k.t t0, k.value v0 from p asof left join k on p.user_id = k.user_id and p.t >= k.t),
 b as (select l.*, case when l.t0 = l.t then l.t0 else n.t end t1, case when l.t0 = l.t then l.v0 else n.value end v1 from l asof left join k n on l.user_id = n.user_id and l.t < n.t)
 select event_id, case when t0 is null and t1 is null then 'no_data' when t0 is null then 'before_first' when t1 is null then 'future' when t1 - t0 > {72 * HOUR} then 'gap' else 'ok' end state,
 round(case when t1 - t0 <= {72 * HOUR} then case when t0 = t1 then v0 else v0 + (v1 - v0) * ((t - t0)::double / (t1 - t0)) end end, 6) east from b""")
def gnss_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes at the times of other events; beyond the longest gap there is none."""
    e = track(spark, sf_dir)
    knots = e.where("event_type = 'purchase'").groupBy("user_id", "t").agg(F.max("value").alias("value"))
    b = asof.brackets(e.where("event_type = 'error'").select("event_id", "user_id", "t"), knots, "user_id", ["value"], bucket=48 * HOUR)
    state = asof.gate(72 * HOUR)
    return b.select("event_id", state.alias("state"), F.when(state == "ok", r(asof.interpolated("value"))).alias("east"))


@query(f"""with {TRACK}, n as (select user_id, event_type, count(*) n, sum(value * value) q from track group by all),
 t as (select *, row_number() over (partition by user_id order by n desc, event_type) rn from n)
 select user_id, max(case when rn = 1 then event_type end) dominant, sum(n)::bigint n, round(sqrt(sum(q) / sum(n)), 6) rms from t group by user_id""")
def dominant_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest fix of each track and its residuals' root mean square."""
    n = track(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value") * F.col("value")).alias("q"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "event_type"))["event_type"]
    return n.groupBy("user_id").agg(best.alias("dominant"), F.sum("n").alias("n"), r(F.sqrt(F.sum("q") / F.sum("n"))).alias("rms"))


#: A turn by the angle of (3, 4), a scale and a shift into a local frame.
SIMILARITY = (0.6, 0.8, 1.25, 100.0, -40.0, 7.0)


@query(f"""with v as (select s_suppkey, s_nationkey, s_acctbal / 100 x, (s_suppkey % 50)::double y, (s_suppkey % 7)::double z from supplier)
 select s_suppkey, case when s_nationkey % 5 > 0 then round(100 + 1.25 * (0.6 * x - 0.8 * y), 6) end e, case when s_nationkey % 5 > 0 then round(-40 + 1.25 * (0.8 * x + 0.6 * y), 6) end n, case when s_nationkey % 5 > 0 then round(7 + 1.25 * z, 6) end u from v""")
def georef_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points under a similarity; sessions that have not converged give none."""
    v = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") % 5 > 0).alias("converged"), (F.col("s_acctbal") / 100).alias("x"), (F.col("s_suppkey") % 50).cast("double").alias("y"), (F.col("s_suppkey") % 7).cast("double").alias("z"))
    e, n, u = gnss.similar(SIMILARITY, F.col("x"), F.col("y"), F.col("z"))
    return v.select("s_suppkey", *[F.when(F.col("converged"), r(c)).alias(a) for a, c in zip("enu", (e, n, u), strict=True)])


# ---- correction frames ---------------------------------------------------------------------------------------


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A burst for each event: noise, a frame of a type and size that the event gives, every eleventh with a broken checksum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k in b.column("seq").to_pylist():
                kind = 1001 + k % 30
                payload = bytes([kind >> 4, (kind & 15) << 4]) + bytes((k * 31 + i) % 211 for i in range(k % 40))
                head = bytes([rtcm.PREAMBLE, len(payload) >> 8, len(payload) & 255]) + payload
                sum_ = rtcm.crc24q(head) ^ (k % 11 == 0)
                out.append(bytes([7, rtcm.PREAMBLE, 0xFF, 9][: k % 5]) + head + sum_.to_bytes(3, "big"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, "payload"])

    e = track(spark, sf_dir).select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), "t")
    return e.mapInArrow(run, "session long, seq long, t long, payload binary")


@query(f"""with {TRACK} select user_id session, 1001 + event_id % 30 kind, count(*) frames, sum(2 + event_id % 40)::bigint bytes, 1800000000000000 - max(t) age from track where event_id % 11 > 0 group by all""")
def rtcm_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rtcm.message_counts(rtcm.validated(frames(spark, sf_dir)), 1_800_000_000_000_000)

