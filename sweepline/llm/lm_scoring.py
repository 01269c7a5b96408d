"""Masked pseudo-likelihood scoring by a small bidirectional window network, trained in numpy.

Tokens are words, held in classes: the commonest words of the corpus one each, other words by their last
letters, the rest together. The network predicts the class of a token from those on both sides: tanh of the
sum of a left and a right embedding, then a softmax. A document's score is the sum over all its tokens of
log P(class | neighbours' classes) + log P(word | class). The second term comes from counts of every word of
the corpus, a table that grows with its vocabulary and meets the documents' words in a join. It is smoothed by
``unseen`` counts for each word of a class and for one more that the corpus lacks. score_documents() gives the
first term alone, score_corpus() the sum.

Vocabulary and training cover the whole corpus. What the network learns from, the counts of (left, token,
right), is gathered from all documents, first in each task, then by a shuffle. Training goes over these
counts in rounds: each task improves the broadcast network on its own part, and the parts' networks are
averaged by their weights in Spark; the network's size is fixed, and it alone goes through the driver.

Defined results: a null text is empty; a text without words has 0 tokens, score 0 and a null mean; repeated
rows count and keep their own rows; extra columns are ignored. An empty corpus gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweepline.llm.common import bounded_batches, discard, result, scratch, text_of, written

TOKEN = re.compile(r"[^\W_]+")
EDGE, OTHER = 0, 1


@dataclass(frozen=True)
class Parameters:
    words: int = 128
    endings: int = 126
    ending_letters: int = 2
    hidden: int = 24
    rounds: int = 3
    rate: float = 0.05
    batch: int = 4096
    #: added to each word's count in its class, and the count of a word that the corpus lacks
    unseen: float = 0.1
    seed: int = 11

    @property
    def classes(self) -> int:
        return 2 + self.words + self.endings


def vocabulary(docs: DataFrame, p: Parameters) -> tuple[dict[str, int], dict[str, int]]:
    """Class numbers of the commonest words, and of the commonest endings of all other words."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(text_of()), F.lit(r"([\p{L}\p{N}]+)"), 1)).alias("word"))
    counted, path = written(words.groupBy("word").agg(F.count("*").alias("n")), "lm-words")
    top = [r["word"] for r in counted.orderBy(F.desc("n"), "word").limit(p.words).collect()]
    endings = (
        counted.where(~F.col("word").isin(top))
        .groupBy(F.expr(f"right(word, {p.ending_letters})").alias("ending"))
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "ending")
        .limit(p.endings)
        .collect()
    )
    discard(docs.sparkSession, path)
    return (
        {w: 2 + i for i, w in enumerate(top)},
        {r["ending"]: 2 + p.words + i for i, r in enumerate(endings)},
    )


def classes_of(text: str, words: dict[str, int], endings: dict[str, int], letters: int) -> np.ndarray:
    """Class numbers of a text's tokens, with an edge before and after."""
    found = [
        c if (c := words.get(w)) is not None else endings.get(w[-letters:], OTHER) for w in TOKEN.findall(text.lower())
    ]
    return np.array([EDGE, *found, EDGE], dtype=np.int64)


def members_of(text: str, words: dict[str, int], endings: dict[str, int], letters: int) -> dict[str, tuple[int, int]]:
    """word: (class, count) of a text's tokens that share their class with other words."""
    found = Counter(TOKEN.findall(text.lower()))
    return {w: (endings.get(w[-letters:], OTHER), n) for w, n in found.items() if w not in words}


def triple_counts(docs: DataFrame, words: dict, endings: dict, p: Parameters) -> DataFrame:
    """triple ((left * classes + right) * classes + token) and n over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast((words, endings))
    v, letters = p.classes, p.ending_letters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(v**3, dtype=np.int32)  # of fixed size, however large the task
        for b in batches:
            found = [np.zeros(0, dtype=np.int64)]
            for text in b.column("text").to_pylist():
                c = classes_of(text, *shared.value, letters)
                found.append((c[:-2] * v + c[2:]) * v + c[1:-1])
            keys, n = np.unique(np.concatenate(found), return_counts=True)
            counts[keys] += n.astype(np.int32)
        keys = np.flatnonzero(counts)
        for at in range(0, len(keys), 1 << 16):
            part = keys[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[part].astype(np.int64))], ["triple", "n"])

    bounded_batches(docs.sparkSession)
    each = docs.select(text_of().alias("text")).mapInArrow(run, "triple long, n long")
    return each.groupBy("triple").agg(F.sum("n").alias("n"))


class Network:
    """Left and right embeddings, output weights and biases, kept as one flat array."""

    def __init__(self, flat: np.ndarray, p: Parameters):
        v, h = p.classes, p.hidden
        self.flat = flat
        self.left, self.right, self.out = (flat[i * v * h : (i + 1) * v * h].reshape(v, h) for i in range(3))
        self.bias = flat[3 * v * h :]

    @staticmethod
    def new(p: Parameters) -> Network:
        rng = np.random.default_rng(p.seed)
        flat = rng.normal(0, 0.1, 3 * p.classes * p.hidden + p.classes).astype(np.float32)
        flat[3 * p.classes * p.hidden :] = 0
        return Network(flat, p)

    def hidden(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.tanh(self.left[left] + self.right[right])

    def normaliser(self) -> np.ndarray:
        """log of the softmax's sum for each (left, right)."""
        v = len(self.bias)
        out = np.empty((v, v), dtype=np.float32)
        every = np.arange(v)
        for left in range(v):
            z = self.hidden(np.full(v, left), every) @ self.out.T + self.bias
            top = z.max(axis=1)
            out[left] = top + np.log(np.exp(z - top[:, None]).sum(axis=1))
        return out

    def log_probabilities(self, left: np.ndarray, token: np.ndarray, right: np.ndarray, normaliser: np.ndarray) -> np.ndarray:
        z = np.einsum("ij,ij->i", self.hidden(left, right), self.out[token]) + self.bias[token]
        return z - normaliser[left, right]


def step(net: Network, memory: np.ndarray, pair: np.ndarray, token: np.ndarray, n: np.ndarray, p: Parameters) -> None:
    """One AdaGrad step on weighted examples; ``memory`` holds the squared gradients."""
    left, right = np.divmod(pair, p.classes)
    contexts, at = np.unique(pair, return_inverse=True)  # a context's softmax is computed once
    cl, cr = np.divmod(contexts, p.classes)
    h = net.hidden(cl, cr)
    z = h @ net.out.T + net.bias
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    weight = np.bincount(at, weights=n, minlength=len(contexts)).astype(np.float32)
    z *= weight[:, None]
    np.subtract.at(z, (at, token), n.astype(np.float32))
    z /= n.sum()
    grad = Network(np.zeros_like(net.flat), p)
    grad.out += z.T @ h
    grad.bias += z.sum(axis=0)
    back = (z @ net.out) * (1 - h * h)
    np.add.at(grad.left, cl, back)
    np.add.at(grad.right, cr, back)
    memory += grad.flat**2
    net.flat -= p.rate * grad.flat / np.sqrt(memory + 1e-10)


def train(counts: DataFrame, p: Parameters) -> Network:
    """The network after rounds over the counts, which hashes of the triples have spread over tasks."""
    spark = counts.sparkSession
    net = Network.new(p)
    size = len(net.flat)
    for r in range(p.rounds):
        shared = spark.sparkContext.broadcast(net.flat)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, r=r) -> Iterator[pa.RecordBatch]:
            own, memory, total = Network(shared.value.copy(), p), np.full(size, 1e-6, dtype=np.float32), 0
            rng = np.random.default_rng(p.seed + r)
            for b in batches:
                triple = b.column("triple").to_numpy()
                n = b.column("n").to_numpy().astype(np.float64)
                # whole contexts to a step, contexts in random order
                order = np.argsort(triple)
                pair, token = np.divmod(triple[order], p.classes)
                parts = np.array_split(np.arange(len(order)), max(1, len(order) // p.batch))
                for i in rng.permutation(len(parts)):
                    if len(parts[i]):
                        step(own, memory, pair[parts[i]], token[parts[i]], n[order][parts[i]], p)
                total += n.sum()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(size)), pa.array(own.flat.astype(np.float64) * total), pa.array(np.full(size, float(total)))],
                ["i", "v", "w"],
            )

        parts = counts.mapInArrow(run, "i long, v double, w double")
        rows = parts.groupBy("i").agg((F.sum("v") / F.sum("w")).alias("v"), F.sum("w").alias("w")).where("w > 0").collect()
        flat = net.flat.copy()
        for row in rows:  # as many as the network has numbers
            flat[row["i"]] = row["v"]
        net = Network(flat, p)
        shared.unpersist()
    return net


@dataclass(frozen=True)
class Model:
    words: dict[str, int]
    endings: dict[str, int]
    flat: np.ndarray
    p: Parameters


def fit(docs: DataFrame, p: Parameters = Parameters()) -> Model:
    words, endings = vocabulary(docs, p)
    counts, path = written(triple_counts(docs, words, endings, p), "lm-triples")
    spark = docs.sparkSession
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    spark.conf.set(rows, str(1 << 17))
    try:
        net = train(counts, p)
    finally:
        spark.conf.set(rows, before)
    discard(spark, path)
    return Model(words, endings, net.flat, p)


_ready: dict[int, tuple] = {}


SCORES = "doc_id long, n_tokens long, log_likelihood double, mean_log_likelihood double"
MEMBERS = "members array<struct<word: string, class: int, n: int>>"


def scored(docs: DataFrame, model: Model, members: bool) -> DataFrame:
    """score_documents(), and with ``members`` the words of members_of() as well."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    p = model.p
    kind = pa.list_(pa.struct([("word", pa.string()), ("class", pa.int32()), ("n", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        if id(m) not in _ready:
            _ready.clear()
            net = Network(m.flat, p)
            _ready[id(m)] = net, net.normaliser()
        net, normaliser = _ready[id(m)]
        for b in batches:
            texts = b.column("text").to_pylist()
            coded = [classes_of(t, m.words, m.endings, p.ending_letters) for t in texts]
            n = np.array([len(c) - 2 for c in coded], dtype=np.int64)
            left, token, right = (np.concatenate([c[i : len(c) - 2 + i] for c in coded]) for i in range(3))
            each = np.concatenate([net.log_probabilities(left[i : i + 8192], token[i : i + 8192], right[i : i + 8192], normaliser) for i in range(0, len(token), 8192)] or [np.zeros(0)])
            total = np.bincount(np.repeat(np.arange(len(n)), n), weights=each, minlength=len(n)).astype(np.float64)
            mean = [t / k if k else None for t, k in zip(total.tolist(), n.tolist(), strict=True)]
            arrays = [b.column("doc_id"), pa.array(n), pa.array(total), pa.array(mean, pa.float64())]
            names = ["doc_id", "n_tokens", "log_likelihood", "mean_log_likelihood"]
            if members:
                found = [members_of(t, m.words, m.endings, p.ending_letters) for t in texts]
                ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                flat = [
                    pa.array([w for f in found for w in f], pa.string()),
                    pa.array([c for f in found for c, _ in f.values()], pa.int32()),
                    pa.array([k for f in found for _, k in f.values()], pa.int32()),
                ]
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(flat, fields=list(kind.value_type)), type=kind))
                names.append("members")
            yield pa.RecordBatch.from_arrays(arrays, names)

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, f"{SCORES}, {MEMBERS}" if members else SCORES)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (of the classes, summed over tokens), mean_log_likelihood of every row of docs (doc_id, text)."""
    return scored(docs, model, False)


def member_rows(found: DataFrame) -> DataFrame:
    """row, word, class, n of the members of each row."""
    return found.select("row", F.explode("members").alias("m")).select("row", "m.word", "m.class", "m.n")


def word_table(members: DataFrame, p: Parameters) -> DataFrame:
    """word and log_p (log P(word | class)) of every word of members (word, class, n) that shares its class."""
    words = members.groupBy("word", "class").agg(F.sum("n").alias("n"))
    # as many rows as the network has classes
    sizes = words.groupBy("class").agg((F.sum("n") + p.unseen * (F.count("*") + 1)).alias("size"))
    return words.join(F.broadcast(sizes), "class").select("word", F.log((F.col("n") + p.unseen) / F.col("size")).alias("log_p"))


def score_corpus(docs: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """Train on the corpus and score each of its documents: score_documents(), with the words given their classes. A written table."""
    with scratch(docs.sparkSession):
        found, _ = written(scored(docs, fit(docs, p), True).withColumn("row", F.monotonically_increasing_id()), "lm-scored")
        words, _ = written(word_table(member_rows(found), p), "lm-words")
        each = member_rows(found).join(words, "word").groupBy("row").agg(F.sum(F.col("n") * F.col("log_p")).alias("inside"))
        total = F.col("log_likelihood") + F.coalesce("inside", F.lit(0.0))
        rows = found.drop("members").join(each, "row", "left").select(
            "doc_id",
            "n_tokens",
            total.alias("log_likelihood"),
            F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean_log_likelihood"),
        )
        return result(rows, "lm-scores")
