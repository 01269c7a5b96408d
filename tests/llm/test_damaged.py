"""Damaged media files: every one ends soon, as an image or with a reason."""

import time

import numpy as np
import pytest

from sweepline.llm import media, webp

random = np.random.default_rng(1)
BYTES = webp.encode_bytes(bytes(random.integers(97, 110, 640, dtype=np.uint8)) * 2, 64)
PIXELS = random.integers(0, 1 << 32, (9, 11), dtype=np.uint32)


def ended(data):
    began = time.perf_counter()
    try:
        assert webp.decode(data).ndim == 2
    except (ValueError, IndexError) as e:
        assert str(e)
    return time.perf_counter() - began


@pytest.mark.parametrize("whole", [BYTES, webp.encode_bytes(b"one and the same " * 64, 64)])
def test_every_changed_byte_ends(whole):
    slowest = max(ended(whole[:i] + bytes([whole[i] ^ x]) + whole[i + 1 :]) for i in range(len(whole)) for x in (1, 8, 64, 255))
    assert slowest < 2


def test_every_cut_ends():
    assert max(ended(BYTES[:i]) for i in range(len(BYTES))) < 1
    with pytest.raises(ValueError):
        webp.decode(BYTES[: len(BYTES) // 2])


def test_random_bodies_end():
    heads = BYTES[:25]
    assert max(ended(heads + random.bytes(n)) for n in (10, 100, 1000) for _ in range(100)) < 2


def test_limits_have_reasons(spark):
    with pytest.raises(ValueError, match="more pixels"):
        webp.decode(BYTES, most=100)
    with pytest.raises(ValueError, match="not complete"):
        webp.Code(np.array([1, 2, 3]))
    with pytest.raises(ValueError, match="not complete"):
        webp.Code(np.array([1, 1, 1]))
    broken = BYTES[:40] + bytes(len(BYTES) - 40)
    df = spark.createDataFrame([([BYTES, broken],), ([BYTES],)], "media array<binary>")
    rows = media.decode_media(df).collect()
    assert rows[0]["payload"] is None and rows[0]["error"] and len(rows[1]["payload"]) == 1280
    sizes = sorted((r["width"], r["argb"] is None) for r in media.pixels(df).collect())
    assert sizes == [(0, True), (64, False), (64, False)]
