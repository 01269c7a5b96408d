"""Registered queries on scanner bytes and chunk logs, each with its oracle SQL."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sweepline.operators.prefix import with_running
from sweepline.plans.bindings import TRACK, track
from sweepline.plans.queries import CHUNKS, chunk_log, query, r
from sweepline.session import table
from sweepline.sources import packets, serial


def halves(spark: SparkSession, sf_dir: str, pack) -> DataFrame:
    """A stream for each user with a packet for each event. A chunk ends in the middle of its event's packet, so every packet crosses a seam."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, before in zip(b.column("seq").to_pylist(), b.column("before").to_pylist(), strict=True):
                own, last = pack(k), pack(before) if before is not None else b""
                out.append(last[len(last) // 2 :] + own[: len(own) // 2])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("session", "seq", "t")), pa.array(out, pa.binary())], ["session", "seq", "t", "payload"])

    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    e = track(spark, sf_dir).select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), "t", before.alias("before"))
    return e.mapInArrow(run, "session long, seq long, t long, payload binary")


def d6_packet(k: int) -> bytes:
    n, first = 1 + k % 4, k * 997 % 23040
    last = max(first - 640, 0) if k % 3 == 2 else (first + 32 * (n - 1)) % 23040
    head = bytes([0xAA, 0x55, 10 << 1 | (k % 10 == 0), n]) + struct.pack("<HH", first << 1 | 1, last << 1 | 1)
    body, check = b"", 0
    for i in range(n):
        d, v = (k * 7 + i * 13) % 16000, (k + i) % 256
        s = ((v & 63) << 2 | k & 1, (d & 63) << 2 | v >> 6, d >> 6)
        body += bytes(s)
        check ^= s[0] ^ (s[1] | s[2] << 8)
    for i in range(0, 8, 2):
        check ^= head[i] | head[i + 1] << 8
    return b"\xaa" * (k % 4) + head + struct.pack("<H", check ^ (0x0101 if k % 13 == 0 else 0)) + body


D6 = f"""{TRACK}, p as (select user_id session, event_id k, t, 1 + event_id % 4 n, event_id * 997 % 23040 f, lead(event_id) over (partition by user_id order by event_id) nxt from track),
 g as (select *, case when k % 3 = 2 then greatest(f - 640, 0) else (f + 32 * (n - 1)) % 23040 end l from p where nxt is not null),
 s as (select *, case when n <= 1 then null when l >= f then (l - f) / (n - 1)::double when f > 17280 and l < 5760 then (l + 23040 - f) / (n - 1)::double end own from g where k % 13 > 0),
 c as (select *, case when n <= 1 then 0 else coalesce(own, last_value(own ignore nulls) over (partition by session order by k rows between unbounded preceding and 1 preceding), 0) end step from s),
 e as (select *, unnest(range(n)) i from c)"""


@query(f"""with {D6} select session, k seq, i, round(((f + step * i) % 23040 + 23040) % 23040 / 64, 6) angle, (k * 7 + i * 13) % 16000 distance, (k + i) % 256 intensity, k % 2 = 1 bright, k % 10 = 0 and i = 0 "start" from e""")
def d6_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of packets that noise stands between and chunks cut; packets with a wrong checksum give none."""
    s = serial.d6_samples(serial.packets(halves(spark, sf_dir, d6_packet), "d6"))
    return s.select("session", "seq", "i", r("angle").alias("angle"), "distance", "intensity", "bright", "start")


@query(f"""with {TRACK}, p as (select user_id session, event_id k, lead(event_id) over (partition by user_id order by event_id) nxt from track)
 select session, count(*) packets, count(*) filter (k % 13 > 0) good, count(*) filter (k % 13 = 0) bad, sum(case when k % 13 > 0 then 1 + k % 4 else 0 end)::bigint samples, count(*) filter (k % 13 > 0 and k % 10 = 0) starts from p where nxt is not null group by session""")
def d6_packet_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = serial.packets(halves(spark, sf_dir, d6_packet), "d6")
    n = F.coalesce(F.size("samples"), F.lit(0))
    return p.groupBy("session").agg(
        F.count("*").alias("packets"), F.count_if("vendor_ok").alias("good"), F.count_if(~F.col("vendor_ok")).alias("bad"),
        F.sum(F.when(F.col("vendor_ok"), n).otherwise(0)).cast("long").alias("samples"), F.count_if(F.col("vendor_ok") & F.col("start")).alias("starts"),
    )


@query("""select distinct (event_id * 7 + i * 13) % 16000 distance, round(case when (event_id * 7 + i * 13) % 16000 = 0 then 0 else atan(19.16 * ((event_id * 7 + i * 13) % 16000 - 90.15) / (90.15 * nullif((event_id * 7 + i * 13) % 16000, 0))) end, 9)::double off from events, range(4) r(i)""")
def mechanical_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.explode(F.array(*[(F.col("event_id") * 7 + i * 13) % 16000 for i in range(4)]))
    return track(spark, sf_dir).select(each.alias("distance")).distinct().select("distance", r(serial.mechanical(F.col("distance")), 9).alias("off"))


def stl_packet(k: int) -> bytes:
    first = k * 1777 % 36000
    out = b"\x54\x2c" + struct.pack("<HH", 3600, first)
    out += b"".join(struct.pack("<HB", (k * 11 + i * 7) % 30000, (k + i) % 256) for i in range(12))
    out += struct.pack("<HH", (first + 1100) % 36000, k * 37 % 30000)
    return b"\x54" * (k % 3) + out + bytes([serial.crc8(out) ^ (k % 9 == 0)])


STL = f"""{TRACK}, p as (select user_id session, event_id k, lead(event_id) over (partition by user_id order by event_id) nxt from track), g as (select *, k * 1777 % 36000 f, k * 37 % 30000 ms from p where nxt is not null and k % 9 > 0),
 s as (select *, (ms - lag(ms) over (partition by session order by k) + 30000) % 30000 span from g), d as (select *, sum(coalesce(span, ms)) over (partition by session order by k rows unbounded preceding) device from s), e as (select *, unnest(range(12)) i from d)"""


@query(f"""with {STL} select session, k seq, i, round((f + 1100 * i / 11.0) % 36000 / 100, 6) angle, (k * 11 + i * 7) % 30000 distance, (k + i) % 256 intensity, round(device - span + span * (i + 1) / 12.0, 4)::double ms from e""")
def stl_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = serial.stl_samples(serial.packets(halves(spark, sf_dir, stl_packet), "stl"))
    return s.select("session", F.col("seq"), "i", r("angle").alias("angle"), "distance", "intensity", r("ms", 4).alias("ms"))


@query(f"""with {STL}, a as (select *, (f + 1100 * i / 11.0) % 36000 / 100 angle from e), w as (select *, coalesce((lag(angle) over (partition by session order by k, i) > 270 and angle < 90)::int, 0) cut from a),
 t as (select *, sum(cut) over (partition by session order by k, i rows unbounded preceding) rotation from w) select session, rotation::bigint rotation, count(*) n from t group by all""")
def rotation_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of each turn."""
    s = serial.stl_samples(serial.packets(halves(spark, sf_dir, stl_packet), "stl"))
    return serial.rotations(s, False).groupBy("session", "rotation").agg(F.count("*").alias("n"))


def datagram(k: int) -> bytes:
    if k % 4 == 0:
        n, kind, body = 1, 0, struct.pack("<6f", k % 10, 1, 2, 0.5, k % 8 / 8, 1)
    else:
        n, kind = 1 + k % 3, 1
        body = b"".join(struct.pack("<iiiBB", (k * 13 + i) % 9000 - 4500, k % 700, i * 250, (k + i) % 256, i) for i in range(n))
    checked = struct.pack("<Q", k * 1000) + body
    length = 36 + len(body) + (k % 17 == 0)
    head = struct.pack("<BHHHHBBB12sI", 0, length, 0, n, k % 65536, 0, 9 if k % 19 == 0 else kind, 0, b"", zlib.crc32(checked) ^ (k % 23 == 0))
    return (head + checked)[: 20 if k % 29 == 0 else None]


def datagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([datagram(k) for k in b.column("seq").to_pylist()], pa.binary())], [*b.schema.names, "payload"])

    return track(spark, sf_dir).select(F.col("user_id").alias("session"), F.col("event_id").alias("seq")).mapInArrow(run, "session long, seq long, payload binary")


STATE = "case when event_id % 29 = 0 then 'short' when event_id % 17 = 0 then 'length' when event_id % 19 = 0 then 'type' when event_id % 23 = 0 then 'checksum' else 'ok' end"


@query(f"""select user_id::varchar session, {STATE} state, count(*) n from events group by all""")
def datagram_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets.datagram_states(datagrams(spark, sf_dir)).groupBy("session", "state").agg(F.count("*").alias("n"))


@query(f"""with p as (select user_id::varchar session, event_id k, unnest(range(1 + event_id % 3)) i from events where event_id % 4 > 0 and {STATE} = 'ok')
 select session, k seq, i, k * 1000 t, ((k * 13 + i) % 9000 - 4500) / 1000.0::double x, (k % 700) / 1000.0::double y, i * 0.25::double z, least(255, (k + i) % 256)::int grey, case when ((k * 13 + i) % 9000 - 4500) ** 2 + (k % 700) ** 2 + (i * 250) ** 2 = 0 then 'no_return' when i & 15 <> 0 then 'tag'
  when ((k * 13 + i) % 9000 - 4500) ** 2 + (k % 700) ** 2 + (i * 250) ** 2 < 10000 then 'range' end why from p""")
def datagram_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets.decode_datagrams(datagrams(spark, sf_dir))
    return p.select("session", "seq", "i", "t", "x", "y", "z", packets.grey(F.col("reflectivity")).alias("grey"), packets.reject_reason().alias("why"))


@query(f"""select user_id::varchar session, event_id seq, (event_id % 10)::double gx, 1.0::double gy, 2.0::double gz, 0.5::double ax, ((event_id % 8) / 8.0)::double ay, 1.0::double az from events where event_id % 4 = 0 and {STATE} = 'ok'""")
def imu_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets.datagram_imu(datagrams(spark, sf_dir))


@query(f"""with {TRACK}, b as (select user_id session, event_id seq, t, 1 + event_id % 3 n, t - lag(t) over (partition by user_id order by t, event_id) span from track), p as (select *, unnest(range(n)) i from b)
 select session, seq, i, round(t - coalesce(span, 0) + coalesce(span, 0) * (i + 1) / n::double, 1)::double t_point from p""")
def point_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = track(spark, sf_dir).select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), "t", (1 + F.col("event_id") % 3).alias("n"))
    p = b.select("session", "seq", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    return packets.point_times(p, b, F.expr("t div 604800000000")).withColumn("t_point", r("t_point", 1))


@query(f"""with {CHUNKS}, m as (select *, row_number() over (partition by session order by t, stream, seq) nth from b where t >= 800000000000000) select session, stream, sum(nth * (seq % 7))::bigint place_sum, count(*) n from m group by all""")
def merge_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All streams from a time on in one order, and each chunk's place in it."""
    log = chunk_log(spark, sf_dir).where("t >= 800000000000000")
    parts = [log.where(F.col("stream") % 2 == i) for i in (0, 1)]
    whole = packets.merged(parts)
    placed = with_running(whole, ["session"], ["t", "stream", "seq"], {"nth": F.lit(1).cast("long")}, F.expr("t div 2592000000000"))
    return placed.groupBy("session", "stream").agg(F.sum(F.col("nth") * (F.col("seq") % 7)).alias("place_sum"), F.count("*").alias("n"))


@query("""with k as (select l_suppkey session, l_linenumber::int stream from lineitem) select session, count(distinct stream) streams, bool_or(stream = 7) scanner, bool_or(stream = 6) lidar, bool_or(stream = 5) imu,
 bool_or(stream = 7) and not bool_or(stream = 6) and not bool_or(stream = 5) scanner_only from k group by session""")
def container_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("session"), F.col("l_linenumber").cast("int").alias("stream"))
    return packets.container_class(k, 7, 6, 5)


@query("""with m as (select s_suppkey, s_nationkey from supplier) select s_suppkey, case when s_nationkey % 3 = 0 then 4.0::double end w, case when s_nationkey % 3 = 0 then 10.0::double end total from m""")
def manifest_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four numbers of a manifest; missing manifests, broken ones and other counts give none."""
    text = F.when(F.col("s_nationkey") % 3 == 0, '{"imuCalibration": {"cameraFromImu": [1, 2, 3, 4.0]}}').when(F.col("s_nationkey") % 3 == 1, '{"imuCalibration": {"cameraFromImu": [1, 2]}}')
    m = table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("manifest"))
    q = packets.manifest_numbers(F.col("manifest"), "$.imuCalibration.cameraFromImu", 4)
    return m.select("s_suppkey", q[3].alias("w"), F.aggregate(q, F.lit(0.0), lambda a, x: a + x).alias("total"))
