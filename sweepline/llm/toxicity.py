"""Toxicity by class-conditional Kneser-Ney models.

For each class, words are predicted from the word before (at a text's start from the empty one) by interpolated
Kneser-Ney: bigram counts, absolutely discounted, back off to continuation counts (the number of different words
that a word follows), and these to continuation counts that both classes share, where a word that neither class
has seen counts half. A word's log-likelihood ratio is log P(word | before, toxic) - log P(word | before,
ordinary). Texts are compared by length-normalised ratios: the mean over all words, and the largest mean over
the windows of each width, both for the ratios above and for those of the continuation counts alone; a logistic
fit on labelled documents that the counts have not seen turns these into a score.

Labels are learned from a bounded sample of labelled documents: those with the smallest hashes of doc_id,
at most ``sample`` of them. The tables of their words and bigrams, whole, go to the tasks.

Defined results: a null text is empty; a text without words has the score of zero ratios; repeated labels of
a document count as toxic if any is; a null label is none. Without labels of both classes every score is 0.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweepline.llm.common import bounded_batches, discard, extended, release_memory, text_of, written

WORD = re.compile(r"[^\W\d_]+")
CLASSES = ("ordinary", "toxic")
PARTS = 8


@dataclass(frozen=True)
class Parameters:
    sample: int = 20_000
    discount: float = 0.75
    windows: tuple[int, ...] = (1, 8)
    #: labelled rows with this remainder fit the logistic, the rest the counts
    folds: int = 5
    held_out_fold: int = 0
    logistic_fold: int = 1


@dataclass(frozen=True)
class Model:
    """Words have numbers; the last number is that of all unseen words. Arrays of two rows have the classes ordinary and toxic."""

    names: bytes  # the words by number, a line each
    lower: np.ndarray  # P(word) by continuation, of each class
    seen: np.ndarray  # bigram tokens that a word starts, of each class
    back_off: np.ndarray  # weight of ``lower`` after a word, of each class
    keys: np.ndarray  # sorted: number of the word before * numbers + number of the word
    counts: np.ndarray  # counts of each key, of each class
    p: Parameters

    @cached_property
    def words(self) -> dict[str, int]:
        """Number of each word; made where it is used, so that the driver never holds it."""
        return {w: i for i, w in enumerate(self.names.decode().split("\n"))}

    def ratios(self, text: str) -> np.ndarray:
        """The ratio of each word, given the word before."""
        return self.both_ratios(text)[0]

    def both_ratios(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """ratios(), and those of the words by continuation alone."""
        unseen = self.lower.shape[1] - 1
        at = np.array([self.words.get(w, unseen) for w in ["", *words_of(text)]], dtype=np.int64)
        before, word = at[:-1], at[1:]
        key = before * (unseen + 1) + word
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        own = np.where(self.keys[place] == key, np.maximum(self.counts[:, place] - self.p.discount, 0), 0) / np.maximum(self.seen[:, before], 1)
        lower = self.lower[:, word]
        p = own + self.back_off[:, before] * lower
        return np.log(p[1] / p[0]), np.log(lower[1] / lower[0])

    def features(self, text: str) -> list[float]:
        found = []
        for r in self.both_ratios(text):
            if not len(r):
                return [0.0] * 2 * (1 + len(self.p.windows))
            total = np.concatenate([[0.0], np.cumsum(r)])
            best = [float((total[m:] - total[:-m]).max() / m) for w in self.p.windows for m in [min(w, len(r))]]
            found += [float(r.mean()), *best]
        return found

    def score(self, text: str, weights: tuple[float, ...]) -> float:
        z = np.dot(weights[:-1], self.features(text)) + weights[-1]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


@dataclass(frozen=True)
class Fitted:
    """A model that is broadcast once, for the fit of the weights and for all scores."""

    shared: Broadcast
    weights: tuple[float, ...]  # of each feature, then the intercept


def fold_of(doc_id: Column, folds: int) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, p: Parameters) -> DataFrame:
    """doc_id, toxic, text of the bounded sample, without the held-out fold."""
    chosen = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .where(fold_of(F.col("doc_id"), p.folds) != p.held_out_fold)
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(p.sample)
    )
    # at most p.sample rows of two numbers: small enough to broadcast
    return docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")


def words_of(text: str) -> list[str]:
    """The words of a text, for the counts and for the scores alike."""
    return WORD.findall(text.lower())


def bigram_counts(sample: DataFrame) -> DataFrame:
    """v, w, ordinary, toxic: how often each word follows each word (the empty one at a text's start) in each class."""
    bounded_batches(sample.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: tuple[Counter, Counter] = Counter(), Counter()
            for toxic, text in zip(b.column("toxic").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = words_of(text)
                found[int(toxic > 0)].update(zip(["", *words], words, strict=False))
            pairs = sorted(found[0].keys() | found[1].keys())
            columns = [[v for v, _ in pairs], [w for _, w in pairs], *([f[x] for x in pairs] for f in found)]
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["v", "w", *CLASSES])

    each = sample.select("toxic", text_of().alias("text")).mapInArrow(run, "v string, w string, ordinary long, toxic long")
    return each.groupBy("v", "w").agg(*[F.sum(c).alias(c) for c in CLASSES])


def kneser_ney(counts: DataFrame, p: Parameters) -> Model | None:
    """The model of bigram_counts(), without weights; None where a class has no words."""
    sides = counts.select(
        F.explode(
            F.array(
                F.struct(F.col("v").alias("word"), *[F.col(c).alias(f"{c}_seen") for c in CLASSES],
                         *[(F.col(c) > 0).cast("long").alias(f"{c}_types") for c in CLASSES], *[F.lit(0).cast("long").alias(f"{c}_before") for c in CLASSES]),
                F.struct(F.col("w").alias("word"), *[F.lit(0).cast("long").alias(f"{c}_{k}") for k in ("seen", "types") for c in CLASSES],
                         *[(F.col(c) > 0).cast("long").alias(f"{c}_before") for c in CLASSES]),
            )
        ).alias("s")
    ).select("s.*")
    table = sides.groupBy("word").agg(*[F.sum(f"{c}_{k}").alias(f"{c}_{k}") for k in ("seen", "types", "before") for c in CLASSES])
    table = table.withColumn("hash", F.xxhash64("word")).toArrow()
    # words are numbered by their hashes, by which bigrams find them: no table of words goes back to Spark
    hashes = table.column("hash").to_numpy()
    by_hash = np.argsort(hashes)
    hashes = hashes[by_hash]
    if (hashes[1:] == hashes[:-1]).any():
        raise ValueError("two words share a hash of 64 bits")
    of = lambda k: np.array([table.column(f"{c}_{k}").to_numpy()[by_hash] for c in CLASSES], dtype=np.float64)
    seen, types, before = (np.hstack([of(k), [[0.0], [0.0]]]) for k in ("seen", "types", "before"))
    total = before.sum(axis=1, keepdims=True)
    if not len(table) or not total.all():
        return None
    n = before.shape[1]
    shared = before.sum(axis=0) + 0.5
    shared /= shared.sum()
    spread = p.discount * (before > 0).sum(axis=1, keepdims=True) / total
    lower = (np.maximum(before - p.discount, 0) / total + spread * shared).astype(np.float32)
    back_off = np.where(seen > 0, p.discount * types / np.maximum(seen, 1), 1.0).astype(np.float32)
    seen = seen.astype(np.float32)
    del types, before
    names = "\n".join(table.column("word").take(pa.array(by_hash)).to_pylist()).encode()
    del table, by_hash
    # in parts by the hash of the word before, hence in the order of the keys: beside the arrays that it fills,
    # the driver holds one part
    bounds = [-(2**63) + i * 2**64 // PARTS for i in range(PARTS)]
    part = sum((F.col("v") >= F.lit(low)).cast("int") for low in bounds[1:])
    rows = counts.select(F.xxhash64("v").alias("v"), F.xxhash64("w").alias("w"), *[F.col(c).cast("int").alias(c) for c in CLASSES])
    size = counts.count()
    keys, discovered, end = np.empty(size, np.int64), np.empty((2, size), np.int32), 0
    for i in range(PARTS):
        found = rows.where(part == i).toArrow()
        key = np.searchsorted(hashes, found.column("v").to_numpy()) * n
        key += np.searchsorted(hashes, found.column("w").to_numpy())
        order = np.argsort(key)
        at, end = end, end + len(key)
        keys[at:end] = key[order]
        for own, c in zip(discovered, CLASSES, strict=True):
            own[at:end] = found.column(c).to_numpy()[order]
        del found, key, order
    return Model(names, lower, seen, back_off, keys, discovered, p)


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> tuple[float, ...]:
    """Weights and intercept by damped Newton steps."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    hold = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(steps):
        m = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (m * (1 - m))[:, None]) + hold, a.T @ (y - m) - hold @ w)
        w = w + step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
    return tuple(map(float, w))


def fit(docs: DataFrame, labels: DataFrame, p: Parameters = Parameters()) -> Fitted | None:
    """The model, or None where the labels don't hold both classes."""
    sample = labelled_sample(docs, labels, p)
    logistic = fold_of(F.col("doc_id"), p.folds) == p.logistic_fold
    counts, path = written(bigram_counts(sample.where(~logistic)), "toxicity-bigrams")
    release_memory(docs.sparkSession)
    model = kneser_ney(counts, p)
    discard(docs.sparkSession, path)
    if model is None:
        return None
    shared = docs.sparkSession.sparkContext.broadcast(model)
    del model
    release_memory(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            features = [shared.value.features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(features, pa.list_(pa.float64()))], ["toxic", "x"])

    bounded_batches(docs.sparkSession)
    rows = sample.where(logistic).select(F.col("toxic").cast("int"), "text").mapInArrow(run, "toxic int, x array<double>").collect()
    if len({r["toxic"] for r in rows}) < 2:
        return None
    x, y = np.array([r["x"] for r in rows]), np.array([float(r["toxic"] > 0) for r in rows])
    return Fitted(shared, logistic_fit(x, y))


def score_documents(docs: DataFrame, model: Fitted | None, output: str = "score") -> DataFrame:
    """docs with the score of each text as column ``output``, in place of one that has its name."""
    shared, weights = (model.shared, model.weights) if model else (None, ())
    kept = [c for c in docs.columns if c != output]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [shared.value.score(t or "", weights) if shared else 0.0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(scores, pa.float64())], [*kept, output])

    bounded_batches(docs.sparkSession)
    rows = docs.select(*kept)
    return rows.mapInArrow(run, extended(rows.schema, **{output: "double"}))


def toxicity(docs: DataFrame, labels: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text)."""
    model = fit(docs, labels, p)
    scored = score_documents(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        F.coalesce(fold_of(F.col("doc_id"), p.folds) == p.held_out_fold, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def crc_fold(doc_id: int, folds: int = 5) -> int:
    """The fold of a document, as fold_of() has it."""
    return zlib.crc32(str(doc_id).encode()) % folds
