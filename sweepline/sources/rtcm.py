"""RTCM 3 frames: validation by length and CRC-24Q, counts by message type."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweepline.sources import serial

POLYNOMIAL = 0x1864CFB
PREAMBLE, HEADER, TAIL = 0xD3, 3, 3


def _table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 16
        for _ in range(8):
            c = c << 1 ^ (POLYNOMIAL if c & 0x800000 else 0)
        out.append(c & 0xFFFFFF)
    return out


_TABLE = _table()


def crc24q(data: bytes) -> int:
    c = 0
    for b in data:
        c = (c << 8 & 0xFFFFFF) ^ _TABLE[c >> 16 ^ b]
    return c


def frames_of(data: bytes, own: int | None = None) -> list[tuple[int, int, bool, int | None]]:
    """(place, length, checksum ok, message type) of the frames that begin in the first ``own`` bytes; after a bad one the search goes on a byte later."""
    out, at, own = [], 0, len(data) if own is None else own
    while (at := data.find(PREAMBLE, at)) >= 0 and at < own and at + HEADER <= len(data):
        size = (data[at + 1] & 3) << 8 | data[at + 2]
        end = at + HEADER + size + TAIL
        if data[at + 1] & 0xFC or end > len(data):
            at += 1
            continue
        good = crc24q(data[at : end - TAIL]) == int.from_bytes(data[end - TAIL : end], "big")
        kind = data[at + HEADER] << 4 | data[at + HEADER + 1] >> 4 if size >= 2 else None
        out.append((at, size, good, kind))
        at = end if good else at + 1
    return out


def validated(bursts: DataFrame, block: int = serial.BLOCK) -> DataFrame:
    """session, seq, t, at, size, good, kind of the frames of streams (session, seq, t, payload); a frame may lie across any number of bursts.

    seq and t are of the burst in which a frame begins, at is its place in the session's stream.
    """

    def whole(data: bytes, own: int) -> Iterator[tuple]:
        for at, size, good, kind in frames_of(data, own):
            yield at, HEADER + size + TAIL, size, good, kind

    found = serial.searched(bursts, whole, "size long, good boolean, kind long", HEADER + 1023 + TAIL, "good", {"good": pa.bool_()}, block)
    return found.drop("whole")


def message_counts(frames: DataFrame, now: int) -> DataFrame:
    """Each session's good frames by message type, the bytes of their payloads, and the age of the last one."""
    return frames.where("good and kind is not null").groupBy("session", "kind").agg(
        F.count("*").alias("frames"), F.sum("size").alias("bytes"), (F.lit(now) - F.max("t")).alias("age")
    )
