"""Binary records, point files, streams and geodesy."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sweepline.functions import geodesy
from sweepline.sources import packets, sinks
from sweepline.streaming import live


def test_chunk_prefix_ends_at_the_first_bad_checksum(spark):
    rows = [("s", 1, i, i * 10, bytes([i]), zlib.crc32(bytes([i])) + (i == 3)) for i in range(6)] + [("s", 2, 0, 5, b"x", zlib.crc32(b"x"))]
    chunks = spark.createDataFrame(rows, "session string, stream int, seq long, t long, payload binary, crc32 long")
    good = packets.valid_prefix(chunks)
    assert sorted((r["stream"], r["seq"]) for r in good.collect()) == [(1, 0), (1, 1), (1, 2), (2, 0)]
    summary = {r["stream"]: r for r in packets.stream_summary(good).collect()}
    assert (summary[1]["chunks"], summary[1]["bytes"], summary[1]["t_last"]) == (3, 3, 20)


def test_poses_and_datagrams(spark):
    pose = np.zeros(1, dtype=packets.POSE)
    pose["t"], pose["px"], pose["qw"] = 7, 1.5, 1
    rows = [("s", 0, pose.tobytes()), ("s", 1, pose.tobytes() + b"more"), ("s", 2, b"short"), ("s", 3, None)]
    found = packets.decode_poses(spark.createDataFrame(rows, "session string, seq long, payload binary")).collect()
    assert [(r["seq"], r["t"], r["px"], r["qw"]) for r in found] == [(0, 7, 1.5, 1.0), (1, 7, 1.5, 1.0)]
    points = np.zeros(3, dtype=packets.POINT)
    points["x"], points["tag"] = [0, 1000, 2000], [0, 0, 1]
    checked = struct.pack("<Q", 50) + points.tobytes()
    good = struct.pack("<BHHHHBBB12sI", 0, 36 + points.nbytes, 0, 3, 9, 0, 1, 0, b"", zlib.crc32(checked)) + checked
    imu = struct.pack("<Q6f", 60, 1, 2, 3, 4, 5, 6)
    imu = struct.pack("<BHHHHBBB12sI", 0, 60, 0, 1, 10, 0, 0, 0, b"", zlib.crc32(imu)) + imu
    rows = [("s", 4, good), ("s", 5, good[:-1]), ("s", 6, b""), ("s", 7, good[:-1] + b"x"), ("s", 8, imu)]
    data = spark.createDataFrame(rows, "session string, seq long, payload binary")
    states = {r["seq"]: r["state"] for r in packets.datagram_states(data).collect()}
    assert states == {4: "ok", 5: "length", 6: "short", 7: "checksum", 8: "ok"}
    assert [tuple(r)[1:] for r in packets.datagram_imu(data).collect()] == [(8, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0)]
    found = packets.decode_datagrams(data).withColumn("why", packets.reject_reason()).orderBy("i").collect()
    assert [(r["seq"], r["counter"], r["x"], r["why"]) for r in found] == [(4, 9, 0.0, "no_return"), (4, 9, 1.0, None), (4, 9, 2.0, "tag")]


def test_point_files(spark):
    rows = [(i, i * 0.5, -i * 1.0, 0.25, float(i), i, 255 - i, 7) for i in range(100)]
    points = spark.createDataFrame(rows, "id long, x double, y double, z double, t double, r int, g int, b int").repartition(3)
    parts = sinks.ply_parts(points, ["id"]).collect()
    body = np.frombuffer(b"".join(bytes(p["body"]) for p in parts), dtype=sinks.PLY_ROW)
    assert len(body) == 100 == sum(p["n"] for p in parts) and sorted(body["x"]) == [i * 0.5 for i in range(100)]
    assert b"element vertex 100\n" in sinks.ply_header(100)
    assert sum(len(p["body"]) for p in sinks.pcd_parts(points, ["id"]).collect()) == 1600
    las = sinks.las_parts(points, 0.001, (0.0, 0.0, 0.0), ["id"]).collect()
    first = struct.unpack_from("<iii", min(bytes(p["body"])[:12] for p in las))
    assert sum(len(p["body"]) for p in las) == 3600 and first[2] == 250
    head = sinks.las_header(100, 0.001, (0.0, 0.0, 0.0), (0.0, -99.0, 0.25), (49.5, 0.0, 0.25), 'PROJCS["x"]')
    whole = head + b"".join(bytes(p["body"]) for p in las)
    # a reader that knows the format only
    assert whole[:4] == b"LASF" and whole[24:26] == b"\x01\x04" and struct.unpack_from("<H", whole, 94)[0] == 375
    start, records, form, size = struct.unpack_from("<IIBH", whole, 96)
    assert (records, form, size, struct.unpack_from("<Q", whole, 247)[0]) == (1, 7, 36, 100)
    assert whole[375:].startswith(struct.pack("<H16sH", 0, b"LASF_Projection", 2112)) and len(whole) == start + 100 * size
    assert struct.unpack_from("<6d", whole, 179) == (49.5, 0.0, 0.0, -99.0, 0.25, 0.25)
    xs = sorted(struct.unpack_from("<i", whole, start + i * size)[0] * 0.001 for i in range(100))
    assert xs == pytest.approx([i * 0.5 for i in range(100)])
    assert b"POINTS 100\n" in sinks.pcd_header(100) and sinks.pcd_header(100).endswith(b"DATA binary\n")
    assert sinks.las_scale(0, 10) == 1e-4 and sinks.las_scale(0, 1e9) == pytest.approx(1.0)


def test_streams_equal_batch(spark, tmp_path):
    rows = [("a", i, (i * 37) % 50) for i in range(200)] + [("b", i, i) for i in range(20)]
    schema = "session string, arrival long, t long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    live.accept_in_order(stream).writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    expected, newest = set(), {}
    for s, arrival, t in rows:
        if t > newest.get(s, -1):
            newest[s] = t
            expected.add((s, arrival, t))
    assert {tuple(r) for r in spark.table("kept").collect()} == expected
    points = spark.createDataFrame([(0.1, 0.2, 0.3), (0.4, 0.2, 0.1), (5.0, 5.0, 5.0)], "x double, y double, z double")
    points.write.parquet(str(tmp_path / "points"))
    live.voxel_counts(spark.readStream.schema(points.schema).parquet(str(tmp_path / "points")), 1.0).writeStream.format("memory").queryName("voxels").outputMode("complete").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r["n"] for r in spark.table("voxels").collect()) == [1, 2]


def test_utm_known_points(spark):
    df = spark.createDataFrame([(0.0, 3.0), (60.0, 5.0), (-33.0, 151.0)], "lat double, lon double")
    east, north = geodesy.to_utm(F.col("lat"), F.col("lon"))
    rows = df.select(east.alias("e"), north.alias("n"), geodesy.epsg(F.col("lat"), F.col("lon")).alias("epsg")).collect()
    assert rows[0]["e"] == pytest.approx(500000, abs=1e-6) and rows[0]["n"] == pytest.approx(0, abs=1e-6)
    assert [r["epsg"] for r in rows] == [32631, 32632, 32756]
    assert rows[2]["n"] < 10_000_000 and rows[2]["e"] < 500_000
