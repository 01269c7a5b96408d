"""Media columns: byte payloads kept as lossless WebP images, read back as pixel arrays.

A text's payload is its UTF-8 bytes and 0 bytes up to a positive multiple of 64. Rows of 64 samples make an
image; a payload of more than 16,384 rows makes several. decode_media() reads any lossless WebP file (see
webp.py); a file that it can't read gives nulls and the reason.

Defined results: a null text is empty (64 zero bytes); equal texts have equal files; repeated rows keep their
own rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweepline.llm import webp
from sweepline.llm.common import bounded_batches, extended

UNIT = 64
FILE_BYTES = UNIT * webp.MAX_SIDE


def store_payloads(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (unpadded), media (array<binary>): each text's payload as WebP files."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, media = [], []
            for text in b.column("text").cast(pa.binary()).to_pylist():
                data = text or b""
                payload = data + bytes(-len(data) % UNIT if data else UNIT)
                sizes.append(len(data))
                media.append(
                    [webp.encode_bytes(payload[i : i + FILE_BYTES], UNIT) for i in range(0, len(payload), FILE_BYTES)]
                )
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.list_(pa.binary()))],
                ["doc_id", "n_bytes", "media"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media array<binary>")


def sample_features(samples: np.ndarray) -> str:
    """Mean, entropy in bits, and shares (in thousandths) of sixteen ranges of sample values."""
    counts = np.bincount(samples, minlength=256)
    p = counts[counts > 0] / len(samples)
    ranges = counts.reshape(16, 16).sum(axis=1) * 1000 // len(samples)
    mean = float(counts @ np.arange(256)) / len(samples)
    return f"mean={mean:.4f};entropy={float(-(p * np.log2(p)).sum()):.4f};ranges={','.join(map(str, ranges))}"


def decode_media(media: DataFrame) -> DataFrame:
    """media with ``payload`` (the green samples of all its files), ``feature`` and ``error``."""
    bounded_batches(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            payloads, features, errors = [], [], []
            for files in b.column("media").to_pylist():
                try:
                    parts = [((webp.decode(f) >> np.uint32(8)) & np.uint32(255)).astype(np.uint8) for f in files or []]
                    samples = np.concatenate([x.ravel() for x in parts]) if parts else np.zeros(0, dtype=np.uint8)
                    payloads.append(samples.tobytes())
                    features.append(sample_features(samples) if len(samples) else None)
                    errors.append(None)
                except (ValueError, IndexError) as e:
                    payloads.append(None)
                    features.append(None)
                    errors.append(str(e))
            arrays = [pa.array(payloads, pa.binary()), pa.array(features, pa.string()), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *arrays], [*b.schema.names, "payload", "feature", "error"])

    schema = extended(media.schema, payload="binary", feature="string", error="string")
    return media.mapInArrow(run, schema)


def pixels(media: DataFrame) -> DataFrame:
    """A row for each file of media, with ``file`` (its place, from 0), ``width``, ``height`` and ``argb`` (32-bit numbers, row by row).

    A row without files has one row of size 0, with a null ``file``; a file that can't be read has size 0 and null pixels.
    """
    bounded_batches(media.sparkSession)
    files = media.select("*", F.posexplode_outer("media").alias("file", "one_file__"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            images: list[np.ndarray | None] = []
            for f in b.column("one_file__").to_pylist():
                try:
                    images.append(webp.decode(f) if f else np.zeros((0, 0), dtype=np.uint32))
                except (ValueError, IndexError):
                    images.append(None)
            shapes = [(0, 0) if i is None else i.shape for i in images]
            arrays = [
                pa.array([w for _, w in shapes], pa.int32()),
                pa.array([h for h, _ in shapes], pa.int32()),
                pa.array([None if i is None else i.ravel().astype(np.int64) for i in images], pa.list_(pa.int64())),
            ]
            kept = b.drop_columns(["one_file__"])
            yield pa.RecordBatch.from_arrays([*kept.columns, *arrays], [*kept.schema.names, "width", "height", "argb"])

    schema = extended(files.drop("one_file__").schema, width="int", height="int", argb="array<bigint>")
    return files.mapInArrow(run, schema)


def digests(decoded: DataFrame) -> DataFrame:
    files = F.aggregate("media", F.lit(b""), lambda a, x: F.concat(a, x))
    return decoded.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr(f"substr(payload, -{UNIT})")).alias("tail_crc32"),
        F.octet_length(files).cast("long").alias("media_bytes"),
        F.sha2(files, 256).alias("media_sha256"),
        "feature",
    )
