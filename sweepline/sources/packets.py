"""Binary records: chunk logs, pose chunks and point datagrams, decoded in Arrow batches."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweepline.operators.prefix import with_previous


def valid_prefix(chunks: DataFrame) -> DataFrame:
    """The chunks of each stream before its first bad one. chunks: (session, stream, seq, payload, crc32).

    Only the first bad number of each stream, one small row, meets the payloads.
    """
    bad = F.coalesce(F.crc32("payload") != F.col("crc32"), F.lit(True))
    first_bad = chunks.where(bad).groupBy("session", "stream").agg(F.min("seq").alias("_bad"))
    return chunks.join(first_bad, ["session", "stream"], "left").where("_bad is null or seq < _bad").drop("_bad")


def chunk_states(chunks: DataFrame) -> DataFrame:
    """chunks with ``state``: ok, mismatch, truncated (shorter than ``size`` says), or after_bad."""
    own = F.when(F.octet_length("payload") < F.col("size"), "truncated").when(F.crc32("payload") != F.col("crc32"), "mismatch").otherwise("ok")
    at = chunks.withColumn("state", F.when(F.col("payload").isNull(), "truncated").otherwise(own))
    first_bad = at.where("state <> 'ok'").groupBy("session", "stream").agg(F.min("seq").alias("_bad"))
    at = at.join(first_bad, ["session", "stream"], "left")
    return at.withColumn("state", F.when(F.col("seq") > F.col("_bad"), "after_bad").otherwise(F.col("state"))).drop("_bad")


def merged(streams: Sequence[DataFrame], t: str = "t") -> DataFrame:
    """All streams' chunks in one order of (t, stream, seq)."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out.orderBy(t, "stream", "seq")


def container_class(chunks: DataFrame, scanner: int, lidar: int, imu: int) -> DataFrame:
    """Of each session: which streams it has, and whether it is a project of the spinning scanner alone."""
    has = lambda s: F.bool_or(F.col("stream") == s)
    found = chunks.groupBy("session").agg(F.countDistinct("stream").alias("streams"), has(scanner).alias("scanner"), has(lidar).alias("lidar"), has(imu).alias("imu"))
    return found.withColumn("scanner_only", F.col("scanner") & ~F.col("lidar") & ~F.col("imu"))


def manifest_numbers(manifest: Column, path: str, n: int) -> Column:
    """The n numbers at a path of a manifest; null where there are others, or something else."""
    numbers = F.from_json(F.get_json_object(manifest, path), "array<double>")
    return F.when((F.size(numbers) == n) & ~F.exists(numbers, lambda x: x.isNull() | F.isnan(x)), numbers)


def stream_summary(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("session", "stream").agg(
        F.count("*").alias("chunks"), F.sum(F.octet_length("payload")).alias("bytes"), F.min("t").alias("t_first"), F.max("t").alias("t_last")
    )


POSE = np.dtype([("t", "<i8"), ("px", "<f8"), ("py", "<f8"), ("pz", "<f8"), ("qx", "<f4"), ("qy", "<f4"), ("qz", "<f4"), ("qw", "<f4")])


def decode_poses(chunks: DataFrame) -> DataFrame:
    """session, seq and the pose fields of each payload that is long enough; longer ones are read up to the record's end."""
    names = POSE.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(s, n, p[: POSE.itemsize]) for s, n, p in zip(*(b.column(c).to_pylist() for c in ("session", "seq", "payload")), strict=True) if p and len(p) >= POSE.itemsize]
            found = np.frombuffer(b"".join(r[2] for r in rows), dtype=POSE)
            arrays = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array(found["t"])]
            arrays += [pa.array(found[n].astype("<f8")) for n in names[1:]]
            yield pa.RecordBatch.from_arrays(arrays, ["session", "seq", *names])

    kinds = ", ".join(f"{n} {'long' if n == 't' else 'double'}" for n in names)
    return chunks.select("session", "seq", "payload").mapInArrow(run, f"session string, seq long, {kinds}")


IMU = np.dtype([("gx", "<f4"), ("gy", "<f4"), ("gz", "<f4"), ("ax", "<f4"), ("ay", "<f4"), ("az", "<f4")])


def _imu_rows(chunks: DataFrame, body: Callable[[bytes], bytes | None]) -> DataFrame:
    """session, seq and the six fields of the sample that ``body`` finds in each payload; payloads in which it finds none give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(s, n, body(p or b"")) for s, n, p in zip(*(b.column(c).to_pylist() for c in ("session", "seq", "payload")), strict=True)]
            rows = [r for r in found if r[2] is not None]
            fields = np.frombuffer(b"".join(r[2] for r in rows), dtype=IMU)
            arrays = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(fields[n].astype("<f8")) for n in IMU.names)], ["session", "seq", *IMU.names])

    kinds = ", ".join(f"{n} double" for n in IMU.names)
    return chunks.select(F.col("session").cast("string").alias("session"), "seq", "payload").mapInArrow(run, f"session string, seq long, {kinds}")


def decode_imu(chunks: DataFrame) -> DataFrame:
    """session, seq and the six fields of each payload of at least 24 bytes."""
    return _imu_rows(chunks, lambda p: p[: IMU.itemsize] if len(p) >= IMU.itemsize else None)


#: Version, length, time interval, points, counter, frame, data type, time type, 12 reserved bytes, CRC-32, time.
HEADER = "<BHHHHBBB12sIQ"
HEADER_SIZE = struct.calcsize(HEADER)
CHECKED_FROM = 28  # the checksum covers the time and all that follows
POINT = np.dtype([("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("reflectivity", "u1"), ("tag", "u1")])
COARSE_POINT = np.dtype([("x", "<i2"), ("y", "<i2"), ("z", "<i2"), ("reflectivity", "u1"), ("tag", "u1")])
#: data type: row form, units in a metre
FORMS = {1: (POINT, 1000), 2: (COARSE_POINT, 100)}
DATAGRAM_STATES = ("ok", "short", "length", "type", "points", "checksum")


def datagram_head(p: bytes | None) -> tuple[str, tuple | None]:
    """The state of a datagram, and its head where it has one."""
    if not p or len(p) < HEADER_SIZE:
        return "short", None
    head = struct.unpack_from(HEADER, p)
    kind, dots = head[6], head[3]
    if head[1] != len(p):
        return "length", head
    if kind != 0 and kind not in FORMS:
        return "type", head
    size = IMU.itemsize if kind == 0 else FORMS[kind][0].itemsize
    if not dots or dots * size > len(p) - HEADER_SIZE:
        return "points", head
    return "ok" if zlib.crc32(p[CHECKED_FROM:]) == head[9] else "checksum", head


def datagram_states(datagrams: DataFrame) -> DataFrame:
    """session, seq, state, data_type and counter of every datagram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads = [datagram_head(p) for p in b.column("payload").to_pylist()]
            arrays = [pa.array([s for s, _ in heads], pa.string()), pa.array([h and h[6] for _, h in heads], pa.int64()), pa.array([h and h[4] for _, h in heads], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column("session"), b.column("seq"), *arrays], ["session", "seq", "state", "data_type", "counter"])

    rows = datagrams.select(F.col("session").cast("string").alias("session"), "seq", "payload")
    return rows.mapInArrow(run, "session string, seq long, state string, data_type long, counter long")


def decode_datagrams(datagrams: DataFrame) -> DataFrame:
    """One row for each point of each good datagram (session, seq, payload); coordinates in metres, time of the datagram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for s, n, p in zip(*(b.column(c).to_pylist() for c in ("session", "seq", "payload")), strict=True):
                state, head = datagram_head(p)
                if state != "ok" or head[6] not in FORMS:
                    continue
                dots, (form, metre) = head[3], FORMS[head[6]]
                points = np.frombuffer(p, dtype=form, offset=HEADER_SIZE, count=dots)
                where = [points[a].astype(np.float64) / metre for a in ("x", "y", "z")]
                out.append(([s] * dots, np.full(dots, n), np.full(dots, head[4]), np.full(dots, head[10]), np.arange(dots), *where, points["reflectivity"], points["tag"]))
            if out:
                arrays = [pa.array([s for o in out for s in o[0]], pa.string())]
                arrays += [pa.array(np.concatenate([o[i] for o in out]).astype(np.float64 if 5 <= i < 8 else np.int64)) for i in range(1, 10)]
                yield pa.RecordBatch.from_arrays(arrays, ["session", "seq", "counter", "t", "i", "x", "y", "z", "reflectivity", "tag"])

    return datagrams.select(F.col("session").cast("string").alias("session"), "seq", "payload").mapInArrow(
        run, "session string, seq long, counter long, t long, i long, x double, y double, z double, reflectivity long, tag long"
    )


def datagram_imu(datagrams: DataFrame) -> DataFrame:
    """session, seq and the six fields of the good datagrams that hold an IMU sample; each is judged by itself, whatever shares its number."""

    def sample(p: bytes) -> bytes | None:
        state, head = datagram_head(p)
        return p[HEADER_SIZE : HEADER_SIZE + IMU.itemsize] if state == "ok" and head[6] == 0 else None

    return _imu_rows(datagrams, sample)


def point_times(points: DataFrame, batches: DataFrame, bucket: Column) -> DataFrame:
    """points (session, seq, i, ...) with ``t_point``: evenly from the time of the batch before to the own batch's, which the last point has.

    batches: (session, seq, t, n), one row a batch, n its points. Points of a session's first batch have its time.
    """
    at = with_previous(batches, ["session"], ["t", "seq"], {"_from": "t"}, bucket)
    span = F.col("t") - F.coalesce("_from", "t")
    timed = at.select("session", "seq", F.col("t").alias("_t"), span.alias("_span"), F.col("n").alias("_n"))
    t = F.col("_t") - F.col("_span") + F.expr("_span * (i + 1) / _n")
    return points.join(timed, ["session", "seq"]).withColumn("t_point", t).drop("_t", "_span", "_n")


def grey(reflectivity: Column) -> Column:
    """Red, green and blue of a reflectivity are the same."""
    return F.greatest(F.lit(0), F.least(F.lit(255), reflectivity)).cast("int")


def reject_reason(low_reflectivity: int = 0, near: float = 0.1, far: float = 40.0, tag_mask: int = 0b00001111):
    """The first reason to leave out a point, or null: no return, tag, reflectivity, range."""
    square = F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")
    return (
        F.when(square == 0, "no_return")
        .when(F.col("tag").bitwiseAND(F.lit(tag_mask)) != 0, "tag")
        .when(F.col("reflectivity") < low_reflectivity, "reflectivity")
        .when((square < near * near) | (square > far * far), "range")
    )
