"""Byte-level BPE by monoid tree reduction.

A text is cut into leaves of a fixed number of characters at any place. Leaves are encoded by themselves;
neighbours are joined pairwise, up a tree. A join re-encodes a window around the seam and keeps all tokens
outside of it. The window grows, doubling, until both its ends are proven cuts: a white-space character that
follows a character other than white space always starts a match of the splitting pattern, whatever stands
before, and matching from there on depends only on what follows. So tokens outside the window are those of
the whole text, and the tree gives what one pass over the whole text gives. A part without a proven cut would be in
the window whole, so it is not encoded before it meets one: a text without white space is encoded once. Decoding
concatenates up the same kind of tree.

Defined results: a null text is encoded as an empty one, which has no tokens; special-token strings are
ordinary text; repeated rows keep their own rows; extra columns pass through. Where one has the name of an output
column (tokens, decoded, n_tokens), that output's name ends in ``_``.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweepline.llm.common import bounded_batches, extended, free_name

LEAF_CHARS = 1024
FIRST_WINDOW = 32
#: A proven cut lies before the white space of each match.
CUT = re.compile(r"(?<=[^\s])[ \n]")

NONE = np.zeros(0, dtype="<u4")

_coders: dict[str, Coder] = {}


class Coder:
    """Encodes and decodes by ranks in the tiktoken format; one for each worker process and vocabulary."""

    def __init__(self, vocabulary: bytes, pattern: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.plain = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token

    @staticmethod
    def of(vocabulary: bytes, pattern: str) -> Coder:
        key = hashlib.sha256(vocabulary + pattern.encode()).hexdigest()
        if key not in _coders:
            _coders[key] = Coder(vocabulary, pattern)
        return _coders[key]

    def leaf(self, text: str) -> np.ndarray:
        return np.array(self.plain.encode_ordinary(text), dtype="<u4")

    def encode(self, text: str, leaf_chars: int = LEAF_CHARS) -> np.ndarray:
        spans = [(a, min(a + leaf_chars, len(text))) for a in range(0, len(text), leaf_chars)]
        if len(spans) < 2:
            return self.leaf(text) if text else NONE
        level = [(a, b, self.leaf(text[a:b]) if CUT.search(text, a + 1, b) else None) for a, b in spans]
        while len(level) > 1:
            paired = [self.join(text, *level[i : i + 2]) for i in range(0, len(level) - 1, 2)]
            level = paired + level[2 * len(paired) :]
        a, b, tokens = level[0]
        return self.leaf(text[a:b]) if tokens is None else tokens

    def join(self, text: str, left: tuple, right: tuple) -> tuple:
        """Two neighbouring (start, end, tokens) as one; tokens are None where the part has no proven cut."""
        a, seam, head = left
        _, b, tail = right
        start = a if head is None else last_cut(text, a, seam)
        # the right part's first character may itself be a proven cut
        end = b if tail is None else first_cut(text, seam, b)
        if start == a and end == b and not CUT.search(text, a + 1, b):
            return a, b, None
        head = NONE if head is None else head
        tail = NONE if tail is None else tail
        keep = self.tokens_of(head[::-1], len(text[start:seam].encode()))
        skip = self.tokens_of(tail, len(text[seam:end].encode()))
        window = self.leaf(text[start:end])
        return a, b, np.concatenate([head[: len(head) - keep], window, tail[skip:]])

    def tokens_of(self, tokens: np.ndarray, n_bytes: int) -> int:
        """How many of the first tokens make up n_bytes."""
        n = 0
        for i, t in enumerate(tokens):
            if n >= n_bytes:
                return i
            n += len(self.bytes_of[t])
        return len(tokens)

    def decode(self, tokens: np.ndarray) -> bytes:
        level = [
            b"".join(map(self.bytes_of.__getitem__, tokens[i : i + LEAF_CHARS].tolist()))
            for i in range(0, len(tokens), LEAF_CHARS)
        ]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0] if level else b""


def last_cut(text: str, start: int, seam: int) -> int:
    """The last proven cut of text[start:seam], or start."""
    window = FIRST_WINDOW
    while True:
        low = max(start, seam - window)
        cuts = [m.start() for m in CUT.finditer(text, low, seam) if m.start() > low]
        if cuts or low == start:
            return cuts[-1] if cuts else start
        window *= 2


def first_cut(text: str, seam: int, end: int) -> int:
    """The first proven cut of text[seam:end] behind its first character, or end."""
    window = FIRST_WINDOW
    while True:
        high = min(end, seam + window)
        found = CUT.search(text, seam + 1, high)
        if found or high == end:
            return found.start() if found else end
        window *= 2


def public_vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[bytes, str]:
    """A public vocabulary file's bytes and its splitting pattern, read on the driver."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, vocabulary: bytes, pattern: str, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """docs with ``tokens`` in place of ``text``: the ids as little-endian unsigned 32-bit integers."""
    spark = bounded_batches(docs.sparkSession)
    shared = spark.sparkContext.broadcast((vocabulary, pattern))
    kept = [c for c in docs.columns if c != "text"]
    name = free_name("tokens", kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(*shared.value)
        for b in batches:
            tokens = [coder.encode(t or "", leaf_chars).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(tokens, pa.binary())], [*kept, name])

    rows = docs.select(*kept, "text")
    return rows.mapInArrow(run, extended(rows.drop("text").schema, **{name: "binary"}))


def decode_documents(encoded: DataFrame, vocabulary: bytes, pattern: str, tokens: str = "tokens") -> DataFrame:
    """encoded (with ids in ``tokens``) with ``decoded``, the bytes that the ids stand for; a null has none."""
    spark = bounded_batches(encoded.sparkSession)
    shared = spark.sparkContext.broadcast((vocabulary, pattern))
    name = free_name("decoded", encoded.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(*shared.value)
        for b in batches:
            ids = (np.frombuffer(t or b"", dtype="<u4") for t in b.column(tokens).to_pylist())
            decoded = pa.array([coder.decode(t) for t in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, decoded], [*b.schema.names, name])

    return encoded.mapInArrow(run, extended(encoded.schema, **{name: "binary"}))


def n_tokens(tokens: str = "tokens") -> Column:
    return F.expr(f"octet_length(`{tokens}`) div 4").cast("long")
