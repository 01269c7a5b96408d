"""Serial scanners: packets found in byte streams, decoded to samples.

A stream is rows (session, seq, t, payload) whose payloads follow each other. It is cut into blocks of bytes, whatever the
rows' sizes; each block is searched together with as many bytes behind it as the longest packet has, and keeps the packets
that begin in it. So a packet may lie across any number of rows, blocks are searched in any task, and no task holds a session.
Packets are found by their first bytes, a plausible head and the checksum; the search goes on behind a good packet, and inside a bad
one. A packet that begins inside a good one before it is dropped. Angles are then a matter of columns, the step of the packet
before being carried in buckets.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweepline.operators.prefix import with_previous, with_running

#: Fixed values of the two packet forms.
D6_HEAD, D6_SAMPLE, D6_MOST = 10, 3, 10 + 3 * 255
STL_BYTES, STL_POINTS, STL_WRAP_MS = 47, 12, 30_000
CRC8_POLYNOMIAL = 0x4D


def d6_checksum(packet: bytes, vendor: bool = True) -> int:
    """The exclusive or of the packet's 16-bit words; the two readings group a sample's three bytes differently."""
    words = np.frombuffer(packet[:8], dtype="<u2").astype(np.int64)
    s = np.frombuffer(packet[D6_HEAD:], dtype=np.uint8).reshape(-1, 3).astype(np.int64)
    pairs = (s[:, 0], s[:, 1] | s[:, 2] << 8) if vendor else (s[:, 0] | s[:, 1] << 8, s[:, 2])
    return int(np.bitwise_xor.reduce(np.concatenate([words, *pairs])))


def d6_packets(data: bytes, own: int) -> list[tuple]:
    """(place, size, vendor ok, literal ok, start, frequency, first angle, last angle, samples) of the packets that begin in the first ``own`` bytes.

    Angles are in 64ths of a degree. Only packets with a plausible head are listed: samples, and the check bit of both angles.
    """
    out, at = [], 0
    while (at := data.find(b"\xaa\x55", at)) >= 0 and at < own:
        n = data[at + 3] if at + D6_HEAD <= len(data) else 0
        end = at + D6_HEAD + D6_SAMPLE * n
        if not n or end > len(data) or not data[at + 4] & data[at + 6] & 1:
            at += 1
            continue
        p = data[at:end]
        said = p[8] | p[9] << 8
        vendor, literal = d6_checksum(p) == said, d6_checksum(p, False) == said
        s = np.frombuffer(p[D6_HEAD:], dtype=np.uint8).reshape(-1, 3).astype(np.int64)
        samples = list(zip((s[:, 2] * 64 + (s[:, 1] >> 2)).tolist(), ((s[:, 1] & 3) * 64 + (s[:, 0] >> 2)).tolist(), (s[:, 0] & 1 > 0).tolist(), strict=True))
        out.append((at, end - at, vendor, literal, p[2] & 1 > 0, p[2] >> 1, (p[4] | p[5] << 8) >> 1, (p[6] | p[7] << 8) >> 1, samples if vendor else None))
        at = end if vendor else at + 2
    return out


def _crc8_of(byte: int) -> int:
    for _ in range(8):
        byte = (byte << 1 ^ CRC8_POLYNOMIAL if byte & 0x80 else byte << 1) & 0xFF
    return byte


CRC8_TABLE = bytes(map(_crc8_of, range(256)))


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = CRC8_TABLE[c ^ b]
    return c


def stl_packets(data: bytes, own: int) -> list[tuple]:
    """(place, size, ok, speed, first angle, last angle, milliseconds, samples); angles in hundredths of a degree."""
    out, at = [], 0
    while (at := data.find(b"\x54\x2c", at)) >= 0 and at < own:
        p = data[at : at + STL_BYTES]
        if len(p) < STL_BYTES:
            break
        good = crc8(p[:-1]) == p[-1]
        w = lambda i, p=p: p[i] | p[i + 1] << 8
        samples = [(w(6 + 3 * i), p[8 + 3 * i]) for i in range(STL_POINTS)]
        out.append((at, STL_BYTES, good, w(2), w(4), w(42), w(44), samples if good else None))
        at += STL_BYTES if good else 1
    return out


D6_FIELDS = "vendor_ok boolean, literal_ok boolean, start boolean, frequency long, first long, last long, samples array<struct<distance: long, intensity: long, bright: boolean>>"
STL_FIELDS = "ok boolean, speed long, first long, last long, ms long, samples array<struct<distance: long, intensity: long>>"
FORMS: dict[str, tuple[Callable, str, int, str]] = {
    "d6": (d6_packets, D6_FIELDS, D6_MOST, "vendor_ok"),
    "stl": (stl_packets, STL_FIELDS, STL_BYTES, "ok"),
}


#: Bytes of a block, and packets that go out together.
BLOCK, FOUND = 1 << 16, 4096


def blocks(chunks: DataFrame, most: int, block: int = BLOCK) -> DataFrame:
    """session, block, pieces: the bytes of each block and the ``most`` behind it, as pieces (base, seq, t, bytes) in order.

    base is a piece's place in its session's stream. A row holds at most ``block + most`` bytes. Only the sizes of chunks are summed
    along a session, in buckets.
    """
    at = chunks.select("session", "seq", "t", F.coalesce("payload", F.lit(b"")).alias("payload")).withColumn("n", F.octet_length("payload").cast("long"))
    bases = with_running(at.select("session", "seq", "n"), ["session"], ["seq"], {"_upto": F.col("n")}, F.expr("seq div 1000"))
    at = at.join(bases.select("session", "seq", (F.col("_upto") - F.col("n")).alias("base")), ["session", "seq"]).where("n > 0")
    first, last = F.greatest(F.lit(0), F.floor((F.col("base") - most) / block)), F.floor((F.col("base") + F.col("n") - 1) / block)
    at = at.withColumn("block", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    low = F.greatest(F.col("base"), F.col("block") * block)
    high = F.least(F.col("base") + F.col("n"), (F.col("block") + 1) * block + most)
    cut = F.substring("payload", (low - F.col("base") + 1).cast("int"), (high - low).cast("int"))
    pieces = at.where(high > low).select("session", "block", F.struct(low.alias("base"), "seq", "t", cut.alias("bytes")).alias("p"))
    return pieces.groupBy("session", "block").agg(F.sort_array(F.collect_list("p")).alias("pieces"))


def searched(chunks: DataFrame, find: Callable, fields: str, most: int, good: str, kinds: dict[str, pa.DataType], block: int = BLOCK) -> DataFrame:
    """session, seq, t, at and ``fields`` of what find(bytes, own) lists: tuples of a place, the whole size, and the fields.

    seq and t are of the row in which a packet begins, at is its place in the session's stream. What begins inside an
    earlier packet that is ``good`` is left out.
    """
    names = [f.strip().split(" ")[0] for f in re.sub(r"<.*>", "", fields).split(",")]
    columns = ["session", "seq", "t", "at", "whole", *names]

    def made(found: list[tuple]) -> pa.RecordBatch:
        values = list(zip(*found, strict=True)) if found else [[]] * len(columns)
        return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(c, pa.int64())) for c, v in zip(columns, values, strict=True)], columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a batch holds thousands of blocks, which as Python values take many times their bytes: one block is taken at a time
        for b in batches:
            found, listed = [], 0
            for row in range(len(b)):
                session, number, pieces = (b.column(c)[row].as_py() for c in ("session", "block", "pieces"))
                bases, start = [p["base"] for p in pieces], number * block
                for place, *rest in find(b"".join(p["bytes"] for p in pieces), (number + 1) * block - bases[0]):
                    at = bases[0] + place
                    if at >= start:
                        p = pieces[bisect_right(bases, at) - 1]
                        found.append((session, p["seq"], p["t"], at, *rest))
                if len(found) >= FOUND:
                    yield made(found)
                    found, listed = [], listed + 1
            if found or not listed:
                yield made(found)

    found = blocks(chunks, most, block).mapInArrow(run, f"session long, seq long, t long, at long, whole long, {fields}")
    alone = with_running(found, ["session"], ["at"], {}, F.expr("at div 1000000"), {"_end": F.when(F.col(good), F.col("at") + F.col("whole"))})
    return alone.where("_end is null or at >= _end").drop("_end")


def packets(chunks: DataFrame, form: str, block: int = BLOCK) -> DataFrame:
    """session, seq, t, at, size and the fields of every packet that stands by itself, good or bad. chunks: (session long, seq long, t long, payload).

    Rows may be of any size, down to single bytes; null and empty payloads have none.
    """
    find, fields, most, good = FORMS[form]
    bright = form == "d6"
    sample = pa.struct([("distance", pa.int64()), ("intensity", pa.int64()), *([("bright", pa.bool_())] if bright else [])])
    kinds = {"vendor_ok": pa.bool_(), "literal_ok": pa.bool_(), "ok": pa.bool_(), "start": pa.bool_(), "samples": pa.list_(sample)}

    def listed(data: bytes, own: int) -> Iterator[tuple]:
        for place, size, *rest, samples in find(data, own):
            yield place, size, *rest, None if samples is None else [dict(zip(("distance", "intensity", "bright"), x, strict=False)) for x in samples]

    return searched(chunks, listed, fields, most, good, kinds, block).withColumnRenamed("whole", "size")


def wrapped(angle: Column, full: float) -> Column:
    return F.pmod(angle, F.lit(full))


def mechanical(distance: Column) -> Column:
    """The angle, in degrees, by which a sample of this distance (millimetres) is off; 0 without a return."""
    d = distance.cast("double")
    return F.when(d != 0, F.atan(19.16 * (d - 90.15) / (90.15 * F.nullif(d, F.lit(0.0))))).otherwise(0.0)


def d6_samples(found: DataFrame, corrected: bool = False) -> DataFrame:
    """session, at, i, angle (degrees), distance (mm), intensity, bright, start of every sample of the good packets.

    The step between samples comes from the packet's two angles; across 0 a turn is added. Where the last angle is below the
    first otherwise, the step of the packet before holds. Without packet, the step is 0. The correction is off unless asked for.
    """
    n = F.size("samples")
    good = found.where("vendor_ok").withColumn("n", n)
    forward = F.when(F.col("n") <= 1, None).when(F.col("last") >= F.col("first"), F.col("last") - F.col("first"))
    forward = forward.when((F.col("first") > 270 * 64) & (F.col("last") < 90 * 64), F.col("last") + 360 * 64 - F.col("first"))
    stepped = good.withColumn("step", forward / (F.col("n") - 1).cast("double"))
    carried = with_previous(stepped, ["session"], ["at"], {"before": "step"}, F.expr("at div 1000000"), nulls=False)
    step = F.when(F.col("n") <= 1, 0.0).otherwise(F.coalesce("step", "before", F.lit(0.0)))
    each = carried.select("session", "seq", "t", "at", "start", F.col("first"), step.alias("step"), F.posexplode("samples").alias("i", "s"))
    angle = F.col("first") + F.col("step") * F.col("i")
    if corrected:
        angle = angle + 64 * mechanical(F.col("s.distance"))
    return each.select("session", "seq", "t", "at", F.col("i").cast("long").alias("i"), (wrapped(angle, 360.0 * 64) / 64).alias("angle"), "s.distance", "s.intensity", "s.bright", (F.col("start") & (F.col("i") == 0)).alias("start"))


def stl_samples(found: DataFrame) -> DataFrame:
    """session, at, i, angle (degrees), distance (mm), intensity and device time (ms, from the stream's first packet) of every sample.

    Device times wrap at 30 s; a packet's samples lie evenly between the packet before and this one, the last on its own time.
    """
    good = found.where("ok")
    before = with_previous(good, ["session"], ["at"], {"before": "ms"}, F.expr("at div 1000000"))
    span = F.pmod(F.col("ms") - F.col("before") + STL_WRAP_MS, F.lit(STL_WRAP_MS))
    timed = with_running(before.withColumn("span", span), ["session"], ["at"], {"device": F.coalesce("span", "ms")}, F.expr("at div 1000000"))
    turn = F.when(F.col("last") < F.col("first"), F.col("last") + 36000).otherwise(F.col("last")) - F.col("first")
    each = timed.select("session", "seq", "at", "first", turn.alias("turn"), "device", "span", F.posexplode("samples").alias("i", "s"))
    angle = wrapped(F.col("first") + F.col("turn") * F.col("i") / float(STL_POINTS - 1), 36000.0) / 100
    ms = F.col("device") - F.col("span") + F.col("span") * (F.col("i") + 1) / float(STL_POINTS)
    return each.select("session", "seq", "at", F.col("i").cast("long").alias("i"), angle.alias("angle"), "s.distance", "s.intensity", ms.alias("ms"))


def rotations(samples: DataFrame, starts: bool) -> DataFrame:
    """samples with ``rotation``: counted by start packets, or where the angle falls from the last quarter into the first."""
    order, bucket = ["at", "i"], F.expr("at div 1000000")
    if starts:
        cut = F.col("start")
        return with_running(samples, ["session"], order, {"rotation": cut.cast("long")}, bucket)
    at = with_previous(samples, ["session"], order, {"_before": "angle"}, bucket)
    cut = (F.col("_before") > 270) & (F.col("angle") < 90)
    return with_running(at, ["session"], order, {"rotation": cut.cast("long")}, bucket).drop("_before")
