"""Framing over rows of any size: packets of every length in streams cut anywhere."""

import struct
import zlib

import pytest

from sweepline.sources import packets, rtcm, serial


def d6(k, n):
    head = bytes([0xAA, 0x55, 20 | (k % 4 == 0), n]) + struct.pack("<HH", 2 * k % 20000 << 1 | 1, (2 * k + n) % 20000 << 1 | 1)
    body = b"".join(bytes([(k + i) * 4 & 0xFC, i * 4 & 0xFC, (k * 3 + i) % 256]) for i in range(n))
    check = 0
    for i in range(0, 8, 2):
        check ^= head[i] | head[i + 1] << 8
    for i in range(0, len(body), 3):
        check ^= body[i] ^ (body[i + 1] | body[i + 2] << 8)
    return head + struct.pack("<H", check) + body


def stl(k):
    out = b"\x54\x2c" + struct.pack("<HH", 3600, k * 1777 % 36000) + b"".join(struct.pack("<HB", k * 11 + i, i) for i in range(12)) + struct.pack("<HH", k * 1777 % 36000, k * 37 % 30000)
    return out + bytes([serial.crc8(out)])


def frame(k, size):
    body = bytes([(1000 + k % 90) >> 4, (1000 + k % 90) << 4 & 0xFF]) + bytes((k * 7 + i) % 256 for i in range(size - 2))
    head = bytes([rtcm.PREAMBLE, size >> 8, size & 255]) + body
    return head + rtcm.crc24q(head).to_bytes(3, "big")


def streams(spark, parts, sizes):
    """The same stream for each chunk size as a session; and where each part begins."""
    whole, places = b"", []
    for p in parts:
        places.append(len(whole))
        whole += p
    rows = [(size, k, 10 * k, whole[at : at + size]) for size in sizes for k, at in enumerate(range(0, len(whole), size))]
    return spark.createDataFrame([*rows, (sizes[0], len(whole), 0, None)], "session long, seq long, t long, payload binary"), places


@pytest.mark.parametrize("block", [100, 1000, 1 << 16])
def test_d6_packets_of_every_size(spark, block):
    counts = [1, 4, 100, 255, 255, 20, 3]
    parts = [x for k, n in enumerate(counts) for x in (b"\xaa\x55\x01", d6(k, n))]
    sizes = [1, 16, 64, 777, 10_000]
    chunks, places = streams(spark, parts, sizes)
    got = serial.packets(chunks, "d6", block).where("vendor_ok").collect()
    for size in sizes:
        mine = sorted((r.at, r.size, r.seq, r.t, len(r.samples)) for r in got if r.session == size)
        assert mine == [(at, 10 + 3 * n, at // size, 10 * (at // size), n) for at, n in zip(places[1::2], counts, strict=True)]
    assert serial.d6_samples(serial.packets(chunks, "d6", block)).count() == sum(counts) * len(sizes)


def test_stl_and_rtcm_over_seams(spark):
    chunks, places = streams(spark, [x for k in range(40) for x in (b"\x54", stl(k))], [1, 5, 47, 4096])
    got = serial.packets(chunks, "stl", 128).where("ok").groupBy("session").count().collect()
    assert {r.session: r["count"] for r in got} == dict.fromkeys([1, 5, 47, 4096], 40)
    lengths = [2, 30, 1023, 700, 5, 1023]
    chunks, places = streams(spark, [x for k, n in enumerate(lengths) for x in (b"\xd3\xff", frame(k, n))], [1, 100, 5000])
    for block in (200, 1 << 16):
        got = rtcm.validated(chunks, block).where("good").collect()
        for size in (1, 100, 5000):
            assert sorted((r.at, r.size, r.kind, r.seq) for r in got if r.session == size) == [(at, n, 1000 + k, at // size) for k, (at, n) in enumerate(zip(places[1::2], lengths, strict=True))]


def test_blocks_hold_no_more_than_their_bytes(spark):
    chunks, _ = streams(spark, [bytes(5000)], [1, 700, 5000])
    for r in serial.blocks(chunks, 50, 1000).collect():
        sizes = [len(p.bytes) for p in r.pieces]
        assert sum(sizes) <= 1050 and r.pieces[0].base == 1000 * r.block
        assert all(a.base + n == b.base for a, b, n in zip(r.pieces, r.pieces[1:], sizes, strict=False))


def test_no_chunks(spark):
    none = spark.createDataFrame([], "session long, seq long, t long, payload binary")
    assert serial.packets(none, "d6").collect() == [] and rtcm.validated(none).collect() == []


def test_bad_datagram_beside_a_good_one_of_its_number(spark):
    def datagram(value, good=True):
        body = struct.pack("<Q", 5) + struct.pack("<6f", *[value] * 6)
        return struct.pack("<BHHHHBBB12sI", 0, packets.HEADER_SIZE + 24, 0, 1, 0, 0, 0, 0, b"", zlib.crc32(body) ^ (not good)) + body

    rows = [("a", 1, datagram(1.0)), ("a", 1, datagram(2.0, False)), ("a", 2, None), ("a", 3, datagram(3.0)[:30])]
    got = packets.datagram_imu(spark.createDataFrame(rows, "session string, seq long, payload binary")).collect()
    assert [tuple(r) for r in got] == [("a", 1, *[1.0] * 6)]
