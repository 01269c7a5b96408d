"""Point files: each part of a cloud becomes one file body; headers need counts and bounds only."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweepline.operators.prefix import with_running

PLY_ROW = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("r", "u1"), ("g", "u1"), ("b", "u1")])


def _parts(points: DataFrame, columns: list[str], pack, order: list[str]) -> DataFrame:
    """part, n and body: the packed rows of each partition, in ``order`` within it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [b.column(c).to_numpy(zero_copy_only=False) for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array([len(b)], pa.int64()), pa.array([pack(*rows)], pa.binary())], ["n", "body"])

    return points.sortWithinPartitions(*order).select(*columns).mapInArrow(run, "n long, body binary").withColumn("part", F.monotonically_increasing_id())


def ply_parts(points: DataFrame, order: list[str]) -> DataFrame:
    """Little-endian PLY rows of points (x, y, z, r, g, b)."""

    def pack(x, y, z, r, g, b) -> bytes:
        out = np.empty(len(x), dtype=PLY_ROW)
        for name, v in zip(PLY_ROW.names, (x, y, z, r, g, b), strict=True):
            out[name] = v
        return out.tobytes()

    return _parts(points, ["x", "y", "z", "r", "g", "b"], pack, order)


def ply_header(n: int) -> bytes:
    lines = ["ply", "format binary_little_endian 1.0", f"element vertex {n}"]
    lines += [f"property float {a}" for a in "xyz"] + [f"property uchar {c}" for c in ("red", "green", "blue")]
    return ("\n".join([*lines, "end_header"]) + "\n").encode()


def pcd_parts(points: DataFrame, order: list[str]) -> DataFrame:
    """PCD rows: three floats and the colour packed into the bits of a fourth."""

    def pack(x, y, z, r, g, b) -> bytes:
        out = np.empty((len(x), 4), dtype="<f4")
        out[:, 0], out[:, 1], out[:, 2] = x, y, z
        colour = (np.asarray(r, "<u4") << 16) | (np.asarray(g, "<u4") << 8) | np.asarray(b, "<u4")
        out[:, 3] = colour.astype("<u4").view("<f4")
        return out.tobytes()

    return _parts(points, ["x", "y", "z", "r", "g", "b"], pack, order)


def las_scale(low: float, high: float, finest: float = 1e-4) -> float:
    """The finest power of ten, from ``finest`` up, at which the extent fits 32 bits around its middle."""
    scale = finest
    while (high - low) / 2 / scale > 2**31 - 1:
        scale *= 10
    return scale


def las_rows(points: DataFrame, scale: float, offsets: tuple[float, float, float]) -> DataFrame:
    """points with the quantised integers qx, qy, qz, rounded half away from zero."""
    return points.withColumns({f"q{a}": F.round((F.col(a) - o) / scale).cast("int") for a, o in zip("xyz", offsets, strict=True)})


LAS_ROW = np.dtype([
    ("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("intensity", "<u2"), ("returns", "u1"), ("flags", "u1"), ("class", "u1"), ("user", "u1"),
    ("angle", "<i2"), ("source", "<u2"), ("time", "<f8"), ("r", "<u2"), ("g", "<u2"), ("b", "<u2"),
])


def las_parts(points: DataFrame, scale: float, offsets: tuple[float, float, float], order: list[str]) -> DataFrame:
    """Point rows of format 7 (x, y, z, intensity, time, colour). The intensity is the colour's grey."""

    def pack(x, y, z, t, r, g, b) -> bytes:
        out = np.zeros(len(x), dtype=LAS_ROW)
        out["x"], out["y"], out["z"], out["time"], out["returns"] = x, y, z, t, 0x11
        for name, v in zip("rgb", (r, g, b), strict=True):
            out[name] = np.asarray(v, np.int64) * 257
        out["intensity"] = (299 * np.asarray(r, np.int64) + 587 * np.asarray(g, np.int64) + 114 * np.asarray(b, np.int64) + 500) // 1000 * 257
        return out.tobytes()

    return _parts(las_rows(points, scale, offsets), ["qx", "qy", "qz", "t", "r", "g", "b"], pack, order)


def las_header(n: int, scale: float, offsets: tuple[float, float, float], low: tuple[float, float, float], high: tuple[float, float, float], wkt: str = "") -> bytes:
    """The head of a LAS 1.4 file of format 7, with the reference system as well-known text, if there is one."""
    text = wkt.encode() + b"\0" if wkt else b""
    record = struct.pack("<H16sHH32s", 0, b"LASF_Projection", 2112, len(text), b"WKT") + text if wkt else b""
    ends = [v for pair in zip(high, low, strict=True) for v in pair]
    head = struct.pack("<4sHH16sBB32s32sHHHIIBHI5I", b"LASF", 0, 16, b"", 1, 4, b"EXPORT", b"sweepline", 1, 2024, 375, 375 + len(record), int(bool(wkt)), 7, LAS_ROW.itemsize, 0, 0, 0, 0, 0, 0)
    return head + struct.pack("<12dQQIQ15Q", *[scale] * 3, *offsets, *ends, 0, 0, 0, n, n, *[0] * 14) + record


def pcd_header(n: int) -> bytes:
    lines = ["# .PCD v0.7 - Point Cloud Data file format", "VERSION 0.7", "FIELDS x y z rgb", "SIZE 4 4 4 4", "TYPE F F F F", "COUNT 1 1 1 1", f"WIDTH {n}", "HEIGHT 1", "VIEWPOINT 0 0 0 1 0 0 0", f"POINTS {n}", "DATA binary"]
    return ("\n".join(lines) + "\n").encode()


def selected(points: DataFrame, streams: list[int], stride: int, low: tuple, high: tuple, order: list[str], bucket: Column) -> DataFrame:
    """Export selection: streams (all if none are named), then every stride-th of their points in order, then inclusive bounds."""
    kept = points.where(F.col("stream").isin(streams)) if streams else points
    placed = with_running(kept, [], order, {"_nth": F.lit(1)}, bucket)
    inside = F.lit(True)
    for a, lo, hi in zip("xyz", low, high, strict=True):
        inside = inside & F.col(a).between(lo, hi)
    return placed.where((F.col("_nth") - 1) % stride == 0).where(inside).drop("_nth")
