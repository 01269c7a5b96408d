"""MinHash near-dedup by a multi-index Hamming join over b-bit signatures.

A document's set holds its distinct five-word shingles as 64-bit hashes. Its signature is K minima, b bits of
each. The signature distance of two documents is the number of unequal minima, whose mean is K * (1 - J) at
Jaccard similarity J. With M chunks and at most D unequal minima, some chunk has at most D // M (pigeonhole),
so each chunk is looked up with every choice of that many of its minima left out: documents within distance
D of each other always share such a key. D follows from the link threshold: a pair at the threshold stays within it but
for one time in 10^5 (less far above it), and M from D, so that one minimum is left out. Members of a bucket are then compared, inside the join that brings them together,
by their sizes and by longer signatures of one bit a minimum, whose distance has such a threshold too; so
only pairs that are close to the link threshold come out. Links are confirmed on the full sets.

Large groups of copies are not expanded into pairs. Equal word sequences are one class. In a bucket, members
are first confirmed against representatives, the most central one first. Buckets whose members are still in
different components then get an index on differences from a representative r: with dx = |X ^ R|, a link asks
|X ^ Y| <= L * (|X| + |Y|), L = (100 - percent) / (100 + percent), so that the two differences share at least
t = (dx + dy - L * (|X| + |Y|)) / 2 shingles; the first one they share, in an order that puts what r lacks
first, then lies within the first dx - t + 1 and dy - t + 1. Members meet by such a shingle only. With t <= 0
both link to r itself, which is confirmed with the differences. So no link between components is lost, and
members that share r's words but not each other's edits never meet. Keys of one document only leave before any
pair is made.

Defined results: a null text is empty; a document without words has an empty set, component itself, and is
kept; rows that repeat a doc_id are one document that has the links of all its texts (set sizes stay the rows' own); a
null doc_id links nothing, has a null component and is kept. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweepline.llm.common import bounded_batches, discard, result, scratch, written
from sweepline.llm.components import connected_components


def most_unequal(trials: int, chance: float, missed: float) -> int:
    """The least D that a binomial number of unequal ones exceeds with a probability of ``missed`` at most."""
    tail = 1.0
    for d in range(trials):
        tail -= comb(trials, d) * chance**d * (1 - chance) ** (trials - d)
        if tail <= missed:
            return d
    return trials


@dataclass(frozen=True)
class Parameters:
    words: int = 5
    #: links: 100 * intersection >= percent * union
    percent: int = 85
    minima: int = 96
    #: how often a pair at the threshold may be further apart than each of the two signature distances allows
    missed: float = 1e-5
    #: rounds against representatives, and with how many of them a node is confirmed in each
    star_rounds: int = 2
    partners: int = 4
    #: one-bit minima, in words of 64, that members of a shared bucket are compared by
    words_of_bits: int = 16
    seed: int = 20_26

    @property
    def distance(self) -> int:
        return most_unequal(self.minima, 1 - self.percent / 100, self.missed)

    @property
    def chunks(self) -> int:
        return self.distance // 2 + 1

    @property
    def errors(self) -> int:
        return self.distance // self.chunks

    @property
    def unequal_bits(self) -> int:
        """Half of all unequal minima differ in their one bit."""
        return most_unequal(64 * self.words_of_bits, (1 - self.percent / 100) / 2, self.missed)


LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _odd(seed: int, n: int) -> np.ndarray:
    return _mixed(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


_BYTE = _odd(7, 256)
_STEP = _U(0xD6E8FEB86659FD93)
_powers = np.multiply.accumulate(np.full(4096, _STEP, dtype=_U))


def word_hashes(data: bytes) -> tuple[np.ndarray, bytes]:
    """A 64-bit hash of each word, and the words joined by single spaces. data is in lower case."""
    global _powers
    words = data.split()
    joined = b" ".join(words)
    if not words:
        return np.zeros(0, dtype=_U), joined
    raw = np.frombuffer(joined, dtype=np.uint8)
    if len(_powers) < len(raw):
        _powers = np.multiply.accumulate(np.full(2 * len(raw), _STEP, dtype=_U))
    space = np.flatnonzero(raw == 32)
    starts = np.concatenate([[0], space + 1])
    lengths = np.diff(np.concatenate([starts, [len(raw) + 1]])) - 1
    place = np.arange(len(raw)) - np.repeat(starts, lengths + 1)[: len(raw)]
    terms = _BYTE[raw] * _powers[place]
    terms[space] = 0
    return _mixed(np.add.reduceat(terms, starts) + lengths.astype(_U)), joined


def shingle_set(data: bytes, words: int) -> tuple[np.ndarray, bytes]:
    """The sorted distinct shingle hashes of a lower-cased text, and its words joined by single spaces."""
    h, joined = word_hashes(data)
    n = len(h)
    if n == 0:
        return h, joined
    width = min(words, n)
    step = _odd(11, words)
    total = np.full(n - width + 1, _U(width))
    for i in range(width):
        total = _mixed(total * step[i] + h[i : n - width + 1 + i])
    return np.unique(total), joined


def signature(shingles: np.ndarray, minima: int, seed: int) -> np.ndarray:
    """b = 16 bits of the minimum of each of so many hash functions."""
    factors = _odd(seed, minima)
    least = np.full(minima, np.iinfo(_U).max, dtype=_U)
    for at in range(0, len(shingles), 512):
        products = shingles[at : at + 512, None] * factors
        np.minimum(least, products.min(axis=0), out=least)
    return _mixed(least).astype(np.uint16)


def sketches(docs: DataFrame, p: Parameters) -> DataFrame:
    """doc_id, n_shingles, sequence (digest of the lower-cased words), signature (16 bits a minimum) and text_hash of every row."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, sequences, signatures = [], [], []
            for text in b.column("text").cast(pa.binary()).to_pylist():
                shingles, joined = shingle_set((text or b"").translate(LOWER), p.words)
                sizes.append(len(shingles))
                sequences.append(hashlib.blake2b(joined, digest_size=16).digest() if len(shingles) else None)
                signatures.append(signature(shingles, p.minima, p.seed).tobytes() if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(sequences, pa.binary()), pa.array(signatures, pa.binary())],
                ["doc_id", "text_hash", "n_shingles", "sequence", "signature"],
            )

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        run, "doc_id long, text_hash long, n_shingles long, sequence binary, signature binary"
    )


def bucket_keys(classes: DataFrame, p: Parameters) -> DataFrame:
    """(node, key): one row for each chunk and each choice of its minima that is left out."""
    from itertools import combinations

    edges = [round(i * p.minima / p.chunks) for i in range(p.chunks + 1)]
    keys = []
    for c, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
        for out in combinations(range(low, high), p.errors):
            runs, at = [], low
            for o in (*out, high):
                if o > at:
                    runs.append(F.substring("signature", 2 * at + 1, 2 * (o - at)))
                at = o + 1
            keys.append(F.xxhash64(F.lit(c), F.lit(",".join(map(str, out))), *runs))
    return classes.select("node", F.explode(F.array(*keys)).alias("key"))


def confirmed(pairs: DataFrame, docs: DataFrame, p: Parameters) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets meet the threshold.

    docs: (node, text, ...), one row a node. Texts travel, not sets: they are the smaller.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            a, b = [], []
            for x, y, tx, ty in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=False):
                if y not in kept:  # after a merge join, rows of one b are neighbours
                    kept = {y: shingle_set(ty.encode().translate(LOWER), p.words)[0]}
                left, right = shingle_set(tx.encode().translate(LOWER), p.words)[0], kept[y]
                if 100 * min(len(left), len(right)) < p.percent * max(len(left), len(right)):
                    continue
                both = len(np.intersect1d(left, right, assume_unique=True))
                if 100 * both >= p.percent * (len(left) + len(right) - both):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    left = pairs.join(docs.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(docs.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def one_bit_signature(shingles: np.ndarray, words: int, seed: int) -> np.ndarray:
    """One bit of the minimum of each of 64 * words hash functions."""
    factors = _odd(seed, 64 * words)
    least = np.full(64 * words, np.iinfo(_U).max, dtype=_U)
    for at in range(0, len(shingles), 64):
        np.minimum(least, (shingles[at : at + 64, None] * factors).min(axis=0), out=least)
    return np.packbits(_mixed(least) & _U(1), bitorder="little").view("<i8")


def bit_columns(p: Parameters) -> list[str]:
    return [f"b{i}" for i in range(p.words_of_bits)]


def with_bits(nodes: DataFrame, p: Parameters) -> DataFrame:
    """nodes (node, text) with set size n and the words of the one-bit signature."""
    bounded_batches(nodes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.translate(LOWER), p.words)[0] for t in b.column("text").cast(pa.binary()).to_pylist()]
            bits = np.array([one_bit_signature(x, p.words_of_bits, p.seed + 1) for x in sets]).reshape(-1, p.words_of_bits)
            arrays = [b.column("node"), b.column("text"), pa.array([len(x) for x in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays([*arrays, *map(pa.array, bits.T.copy())], ["node", "text", "n", *bit_columns(p)])

    kinds = ", ".join(f"{c} long" for c in bit_columns(p))
    return nodes.select("node", "text").mapInArrow(run, f"node long, text string, n long, {kinds}")


def close_enough(p: Parameters) -> Column:
    """Whether the sizes and one-bit signatures of x.* and y.* allow a link."""
    unequal = sum((F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in bit_columns(p)), F.lit(0))
    sizes = 100 * F.least("x.n", "y.n") >= p.percent * F.greatest("x.n", "y.n")
    return sizes & (unequal <= p.unequal_bits)


def differences(pairs: DataFrame, docs: DataFrame, p: Parameters) -> DataFrame:
    """Of each pair (node, rep): size n of the node's set, d of its difference from rep's, linked, and the first shingles of that.

    What rep lacks comes first, each part by hash. As many are kept as any linked partner can need (module docstring).
    docs: (node, text, ...), one row a node.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = []
            for x, r, tx, tr in zip(*(batch.column(c).to_pylist() for c in ("node", "rep", "text", "text_rep")), strict=True):
                if r not in kept:  # after a merge join, rows of one rep are neighbours
                    kept = {r: shingle_set(tr.encode().translate(LOWER), p.words)[0]}
                mine, other = shingle_set(tx.encode().translate(LOWER), p.words)[0], kept[r]
                added = np.setdiff1d(mine, other, assume_unique=True)
                gone = np.setdiff1d(other, mine, assume_unique=True)
                d, n = len(added) + len(gone), len(mine)
                linked = (100 + p.percent) * d <= (100 - p.percent) * (n + len(other))
                first = np.concatenate([added, gone])[: (100 - p.percent) * n // p.percent + 1]
                rows.append((x, r, n, d, linked, first.view("<i8")))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()))
            names = ["node", "rep", "n", "d", "linked", "first"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    left = pairs.join(docs.select("node", "text"), "node")
    both = left.join(docs.select(F.col("node").alias("rep"), F.col("text").alias("text_rep")), "rep")
    return both.select("node", "rep", "text", "text_rep").mapInArrow(
        run, "node long, rep long, n long, d long, linked boolean, first array<long>"
    )


def sharing_differences(differing: DataFrame, component: DataFrame, p: Parameters) -> DataFrame:
    """Distinct pairs (a, b) of nodes in different components whose differences from one rep can make a link."""
    at = differing.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    tokens = at.select("rep", "node", "component", "n", "d", F.posexplode("first").alias("place", "shingle"))
    x, y = tokens.alias("x"), tokens.alias("y")
    more, less = 100 + p.percent, 100 - p.percent
    twice_shared = more * (F.col("x.d") + F.col("y.d")) - less * (F.col("x.n") + F.col("y.n"))  # 2 * more * t
    fits = [2 * more * (F.col(f"{s}.d") - F.col(f"{s}.place")) >= twice_shared for s in "xy"]
    meet = (
        (F.col("x.rep") == F.col("y.rep"))
        & (F.col("x.shingle") == F.col("y.shingle"))
        & (F.col("x.node") < F.col("y.node"))
        & (F.col("x.component") != F.col("y.component"))
        & (100 * F.least("x.n", "y.n") >= p.percent * F.greatest("x.n", "y.n"))
        & fits[0]
        & fits[1]
    )
    return x.join(y, meet).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def central(members: DataFrame, classes: DataFrame) -> DataFrame:
    """members (node, key) with shared, how many bucket members a node meets, over all its keys, and its least doc_id.

    The text that others of a group were made from shares more minima with them than they do with each other,
    so it has the largest number. Of equal numbers the least doc_id decides, in all buckets alike.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("size"))
    shared = members.join(sizes, "key").groupBy("node").agg(F.sum("size").alias("shared"))
    return members.join(shared.join(classes.select("node", "doc_id"), "node"), "node")


def most_central() -> Column:
    return F.struct((-F.col("shared")).alias("shared"), "doc_id")


def mixed_buckets(members: DataFrame, component: DataFrame, turn: Column) -> tuple[DataFrame, DataFrame]:
    """members with their component, and (key, r) of the buckets that hold several: r is the member with the least turn."""
    at = members.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ends = at.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.min(F.struct(turn.alias("h"), "node", "component")).alias("r")
    )
    return at, ends.where("low <> high").select("key", "r")


def near_links(members: DataFrame, nodes: DataFrame, p: Parameters) -> DataFrame:
    """(a, b) links that connect all that the pairs sharing a key connect.

    members: central() of the keys that several nodes share; nodes: (node, text, n, bits), one row a node.
    """
    spark = members.sparkSession
    known = spark.createDataFrame([], "a long, b long")
    old: list[str] = []
    bits = nodes.select("node", "n", *bit_columns(p))
    for round_no in range(p.star_rounds):  # each against its bucket's representative: the most central one, then any
        turn = F.xxhash64("node", "key", F.lit(round_no)) if round_no else most_central()
        at, mixed = mixed_buckets(members, connected_components(known), turn)
        mixed, mixed_at = written(mixed, "near-mixed")
        old.append(mixed_at)
        if mixed.isEmpty():
            break
        x = at.join(mixed.select("key"), "key", "left_semi").join(bits, "node").alias("x")
        y = mixed.select("key", F.col("r.node").alias("node"), F.col("r.component").alias("component")).join(bits, "node").alias("y")
        apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component"))
        close = x.join(y, apart & close_enough(p)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
        some = F.slice(F.array_sort(F.collect_set(F.struct(F.xxhash64("b", F.lit(round_no)), "b"))), 1, p.partners)
        close = close.groupBy("a").agg(F.transform(some, lambda c: c["b"]).alias("b")).select("a", F.explode("b").alias("b"))
        known, path = written(known.unionByName(confirmed(close, nodes, p)), "near-links")
        old.append(path)
    else:  # one order for all buckets, so that those of a group have few representatives
        at, mixed = mixed_buckets(members, connected_components(known), most_central())
        pairs = at.select("node", "key").join(mixed.select("key", F.col("r.node").alias("rep")), "key").select("node", "rep").distinct()
        differing, path = written(differences(pairs.where("node <> rep"), nodes, p), "near-differences")
        old.append(path)
        known, path = written(known.unionByName(differing.where("linked").selectExpr("node as a", "rep as b")), "near-links")
        old.append(path)
        found = confirmed(sharing_differences(differing, connected_components(known), p), nodes, p)
        known, path = written(known.unionByName(found), "near-links")
        old.append(path)
    final, _ = written(known, "near-links")
    for path in old:
        discard(spark, path)
    return final


def near_duplicates(docs: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text), as a written table."""
    with scratch(docs.sparkSession):
        found = result(placed_rows(docs.select("doc_id", "text"), p), "near-duplicates")
    # a document with words stays under its own id only; one without words, or without an id, is kept
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def placed_rows(docs: DataFrame, p: Parameters) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; reads tables of its own."""
    sketched, _ = written(sketches(docs, p), "near-sketches")
    known = sketched.where("sequence is not null and doc_id is not null")
    # a node is a word sequence; its number is its own, as several nodes may have one doc_id as their least
    classes = known.groupBy("sequence").agg(F.min(F.struct("doc_id", "text_hash", "signature")).alias("first"))
    classes, _ = written(
        classes.select("sequence", "first.doc_id", "first.text_hash", "first.signature", F.monotonically_increasing_id().alias("node")),
        "near-classes",
    )
    keys = bucket_keys(classes, p)
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members, _ = written(central(keys.join(shared, "key").distinct(), classes), "near-members")
    wanted = classes.select("node", "doc_id", "text_hash").join(members.select("node").distinct(), "node")
    rows = docs.withColumn("text_hash", F.xxhash64("text")).join(wanted, ["doc_id", "text_hash"])
    texts = rows.groupBy("node").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    nodes, _ = written(with_bits(texts, p), "near-nodes")
    links = near_links(members, nodes, p)
    # rows that repeat a doc_id with other words are one document: their nodes are linked
    repeated = (
        known.groupBy("doc_id")
        .agg(F.min("sequence").alias("low"), F.max("sequence").alias("high"))
        .where("low <> high")
        .select("doc_id")
    )
    several = known.select("doc_id", "sequence").join(repeated, "doc_id").join(classes.select("sequence", "node"), "sequence")
    least = several.groupBy("doc_id").agg(F.min("node").alias("a"))
    joining = several.join(least, "doc_id").select("a", F.col("node").alias("b"))
    component = connected_components(links.unionByName(joining))
    least = classes.select("node", "doc_id").join(component, "node").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = component.join(least, "component").select("node", "component_id")
    placed = classes.join(named, "node", "left").select("sequence", F.coalesce("component_id", "doc_id").alias("component_id"))
    placed = known.select("doc_id", "n_shingles", "sequence").join(placed, "sequence").select("doc_id", "n_shingles", "component_id")
    others = sketched.where("sequence is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return placed.unionByName(others)
