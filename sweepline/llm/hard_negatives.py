"""Hard negatives by bit-sliced integer products of quantised embeddings.

A component x becomes the integer floor(256 x). Rows lie in packed blocks, anchors too; every block of anchors meets every block
of rows. Inside such a pair the rows' components are taken bit-plane by bit-plane, the most significant first. After each plane
a score is known up to an interval, since the planes to come add at least nothing and at most all their bits to each component;
a row goes as soon as its interval can neither reach an anchor's best so far nor the span that is asked for. Whole blocks are
summed while many rows are left, single pairs afterwards.

First every anchor's positives are found, the best of each block and then the best of these; then, with their scores, the negatives
the same way. No task holds more than two blocks, and a pair of blocks gives at most a fixed number of rows for each anchor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sweepline.llm.common import bounded_batches, result, scratch, written

#: Rows with a component of this size or more (|x| >= 65,536) take no part: their products could leave 64 bits.
LARGEST = 1 << 24
NONE = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Parameters:
    scale: int = 256
    #: Every row whose vec_id is divisible by this is an anchor.
    anchor_every: int = 100
    #: Rows whose vec_id is divisible by ``relabel_every`` belong to the next of ``labels`` labels.
    relabel_every: int = 7
    labels: int = 10
    positives: int = 5
    negatives: int = 5
    #: A negative's score is at least low and at most high hundredths of the positive's.
    low: int = 80
    high: int = 100
    #: Rows and anchors in a block.
    rows: int = 4096
    anchors: int = 256


def quantised(vectors: DataFrame, p: Parameters) -> DataFrame:
    """vec_id, label, q (array of integers) of the rows that take part."""
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * p.scale)
    finite = F.forall("scaled", lambda x: x.isNotNull() & ~F.isnan(x) & (x >= -LARGEST + 1) & (x < LARGEST))
    moved = F.when(F.col("vec_id") % p.relabel_every == 0, F.pmod(F.col("label") + 1, F.lit(p.labels))).otherwise(F.col("label"))
    return (
        vectors.select(F.col("vec_id").cast("long"), moved.cast("long").alias("label"), scaled.alias("scaled"))
        .where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("scaled") > 0) & finite)
        .select("vec_id", "label", F.transform("scaled", lambda x: F.floor(x).cast("long")).alias("q"))
    )


def packed(rows: DataFrame, most: int, lists: tuple[str, ...] = ()) -> DataFrame:
    """Blocks of at most ``most`` rows of one vector length each, made where the rows lie, without a shuffle.

    Columns: width, and the rows' vec_id, label and further ``lists`` columns as arrays; q is one long array.
    """
    schema = rows.select("q", *lists, "vec_id", "label").schema
    names = [f for f in schema.fieldNames() if f != "q"]
    kinds = {f.name: f.dataType.simpleString() for f in schema if f.name != "q"}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.Table]] = {}

        def block(width: int) -> pa.RecordBatch:
            t = pa.concat_tables(held.pop(width)).combine_chunks()
            columns = {c: t.column(c).combine_chunks() for c in t.column_names}
            whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            return pa.RecordBatch.from_pydict({"width": pa.array([width], pa.int32()), "q": whole(columns.pop("q").flatten()), **{c: whole(columns[c]) for c in names}})

        for batch in batches:
            sizes = np.diff(batch.column("q").offsets.to_numpy())
            for width in np.unique(sizes).tolist():
                mine = pa.Table.from_batches([batch]).take(pa.array(np.nonzero(sizes == width)[0]))
                while mine.num_rows:
                    room = most - sum(t.num_rows for t in held.get(width, []))
                    held.setdefault(width, []).append(mine.slice(0, room))
                    if mine.num_rows >= room:
                        yield block(width)
                    mine = mine.slice(room)
        for width in list(held):
            yield block(width)

    out = "width int, q array<bigint>, " + ", ".join(f"{c} array<{kinds[c]}>" for c in names)
    return rows.select("q", *names).mapInArrow(pack, out)


def score_intervals(anchors: np.ndarray, rows: np.ndarray, alive: np.ndarray, drop: Callable[..., np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor number, row number, score) of all pairs that are left after the last bit-plane.

    ``drop(a, r, low, high)`` says of pairs with scores between low and high which ones can go; it is asked after every plane.
    """
    bits = int(np.abs(np.where(rows < 0, ~rows, rows)).max(initial=0)).bit_length() + 1  # two's complement
    up, down = np.maximum(anchors, 0).sum(axis=1), np.minimum(anchors, 0).sum(axis=1)
    wide = anchors.astype(np.float64)
    known = np.zeros(alive.shape, np.int64)
    k = bits
    while k and (k == bits or alive.mean() > 0.1):  # whole blocks
        k -= 1
        plane = ((rows >> k) & 1).astype(np.float64)
        part = np.rint(wide @ plane.T).astype(np.int64) << k
        known += -part if k == bits - 1 else part
        rest = (1 << k) - 1
        a, r = np.nonzero(alive)
        gone = drop(a, r, known[a, r] + rest * down[a], known[a, r] + rest * up[a])
        alive[a[gone], r[gone]] = False
    a, r = np.nonzero(alive)
    score = known[a, r]
    while k and len(a):  # what is left, pair by pair
        k -= 1
        part = np.concatenate([
            np.einsum("ij,ij->i", anchors[a[at : at + 65536]], (rows[r[at : at + 65536]] >> k) & 1) for at in range(0, len(a), 65536)
        ])
        score = score + (part << k)
        rest = (1 << k) - 1
        stays = ~drop(a, r, score + rest * down[a], score + rest * up[a])
        a, r, score = a[stays], r[stays], score[stays]
    return a, r, score


def nth_best(group: np.ndarray, value: np.ndarray, n: int, groups: int) -> np.ndarray:
    """By group, the n-th largest value, or NONE where there are fewer."""
    order = np.lexsort((-value, group))
    g, v = group[order], value[order]
    place = np.arange(len(g)) - np.searchsorted(g, g)
    out = np.full(groups, NONE)
    out[g[place == n - 1]] = v[place == n - 1]
    return out


def first_of(group: np.ndarray, score: np.ndarray, tie: np.ndarray, n: int) -> np.ndarray:
    """Positions of the n first of each group: higher scores first, then the smaller tie."""
    order = np.lexsort((tie, -score, group))
    g = group[order]
    return order[np.arange(len(g)) - np.searchsorted(g, g) < n]


def _meet(anchors: DataFrame, rows: DataFrame, columns: tuple[str, ...], groups: int) -> DataFrame:
    """Every block of anchors beside every block of rows of its width; rows are sent once, anchors once for each group of rows."""
    dealt = rows.select("width", *(F.col(c).alias(f"r_{c}") for c in ("q", "vec_id", "label")))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("r_vec_id"), F.lit(groups)))
    sent = anchors.select("width", *columns).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    return dealt.join(sent.hint("shuffle_merge"), ["width", "part"]).drop("part")


def _lists(batch: pa.RecordBatch, k: int, *columns: str) -> list[np.ndarray]:
    return [batch.column(c)[k].values.to_numpy() for c in columns]


def _best_positives(batches: Iterator[pa.RecordBatch], p: Parameters) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            width = batch.column("width")[k].as_py()
            aq, a_id, a_label, a_no, rq, r_id, r_label = _lists(batch, k, "q", "vec_id", "label", "no", "r_q", "r_vec_id", "r_label")
            alive = (a_label[:, None] == r_label[None, :]) & (a_id[:, None] != r_id[None, :])

            def drop(a, r, low, high, n=len(a_id)):
                return high < nth_best(a, low, p.positives, n)[a]

            a, r, score = score_intervals(aq.reshape(-1, width), rq.reshape(-1, width), alive, drop)
            top = first_of(a, score, r_id[r], p.positives)
            a, r = a[top], r[top]
            yield pa.RecordBatch.from_pydict({"no": a_no[a], "positive_id": r_id[r], "positive_score": score[top]})


def _best_negatives(batches: Iterator[pa.RecordBatch], p: Parameters) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            width = batch.column("width")[k].as_py()
            aq, a_id, a_label, a_no, rq, r_id, r_label = _lists(batch, k, "q", "vec_id", "label", "no", "r_q", "r_vec_id", "r_label")
            positives = batch.column("positive_scores")[k].values
            counts = np.diff(positives.offsets.to_numpy())
            score_of = np.full((len(a_id), p.positives), NONE)  # without a positive: an empty span
            score_of[np.arange(p.positives)[None, :] < counts[:, None]] = positives.flatten().to_numpy()
            there = score_of != NONE
            least = np.where(there, -((-p.low * np.where(there, score_of, 0)) // 100), 1)
            most = np.where(there, p.high * np.where(there, score_of, 0) // 100, 0)
            alive = (a_label[:, None] != r_label[None, :]) & there.any(axis=1)[:, None]

            def drop(a, r, low, high, n=len(a_id)):
                stays = np.zeros(len(a), bool)
                for s in range(p.positives):
                    sure = (low >= least[a, s]) & (high <= most[a, s])
                    cut = np.maximum(least[:, s], nth_best(a[sure], low[sure], p.negatives, n))
                    stays |= (least[a, s] <= most[a, s]) & (high >= cut[a]) & (low <= most[a, s])
                return ~stays

            a, r, score = score_intervals(aq.reshape(-1, width), rq.reshape(-1, width), alive, drop)
            for s in range(p.positives):
                fits = np.nonzero((score >= least[a, s]) & (score <= most[a, s]))[0]
                top = fits[first_of(a[fits], score[fits], r_id[r[fits]], p.negatives)]
                yield pa.RecordBatch.from_pydict({
                    "no": a_no[a[top]], "place": np.full(len(top), s + 1, np.int32), "negative_id": r_id[r[top]], "negative_score": score[top],
                })


def hard_negatives(vectors: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """Per anchor and positive the first negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A score is the integer product of two quantised vectors. An anchor's positives are the best other rows of its label; negatives
    are rows of other labels with ``low * positive_score <= 100 * score <= high * positive_score``. Ties go to the smaller vec_id.
    Rows take no part if vec_id or label is null, or if the vector is null, empty or holds a null, a non-finite component or one
    beyond +-65,535. An anchor meets only vectors of its own length. Rows that repeat a vec_id are rows of their own, but never
    positives of an anchor with that vec_id; repeated anchors give their rows again. Further columns are ignored; tables without
    anchors, positives or negatives give no rows.
    """
    spark = bounded_batches(vectors.sparkSession, size="16m")
    with scratch(spark):
        rows, _ = written(quantised(vectors, p), "quantised")
        blocks, _ = written(packed(rows, p.rows), "blocks")
        anchors, _ = written(rows.where(F.col("vec_id") % p.anchor_every == 0).withColumn("no", F.monotonically_increasing_id()), "anchors")
        groups = max(1, min(blocks.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
        columns = ("q", "vec_id", "label", "no")
        met = _meet(packed(anchors, p.anchors, ("no",)), blocks, columns, groups)
        found = met.mapInArrow(lambda b: _best_positives(b, p), "no bigint, positive_id bigint, positive_score bigint")
        nth = F.row_number().over(Window.partitionBy("no").orderBy(F.desc("positive_score"), "positive_id"))
        positives, _ = written(found.withColumn("place", nth).where(F.col("place") <= p.positives), "positives")
        scores = positives.groupBy("no").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("by"))
        scores = scores.select("no", F.transform("by", lambda x: x["positive_score"]).alias("positive_scores"))
        asking = packed(anchors.join(scores, "no"), p.anchors, ("no", "positive_scores"))
        met = _meet(asking, blocks, (*columns, "positive_scores"), groups)
        found = met.mapInArrow(lambda b: _best_negatives(b, p), "no bigint, place int, negative_id bigint, negative_score bigint")
        rank = F.row_number().over(Window.partitionBy("no", "place").orderBy(F.desc("negative_score"), "negative_id"))
        best = found.withColumn("rank", rank).where(F.col("rank") <= p.negatives)
        named = positives.join(anchors.select("no", F.col("vec_id").alias("anchor_id")), "no")
        return result(
            best.join(named, ["no", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"),
            "hard-negatives",
        )
