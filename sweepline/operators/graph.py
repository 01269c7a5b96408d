"""Components, greedy matchings and cycles of many graphs at once, each a table of edges with a ``by`` column for its graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweepline.session import checkpointed


def components(nodes: DataFrame, edges: DataFrame, by: str) -> DataFrame:
    """by, node, label: the smallest node that edges (by, a, b) reach from each of nodes (by, node).

    Labels go to neighbours, then to the label's label, until none changes: about as many rounds as the logarithm of the longest path.
    """
    both = edges.select(by, "a", "b").unionByName(edges.select(by, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = checkpointed(both)
    now = checkpointed(nodes.select(by, "node", F.col("node").alias("label")).distinct())
    while True:
        sent = both.join(now.select(by, F.col("node").alias("b"), "label"), [by, "b"]).groupBy(by, F.col("a").alias("node")).agg(F.min("label").alias("_m"))
        low = now.join(sent, [by, "node"], "left").select(by, "node", F.col("label").alias("_old"), F.least("label", "_m").alias("label"))
        jumps = low.select(by, F.col("node").alias("label"), F.col("label").alias("_j"))
        new = checkpointed(low.join(jumps, [by, "label"], "left").select(by, "node", "_old", F.coalesce("_j", "label").alias("label")))
        now = new.drop("_old")
        if not new.where("label <> _old").take(1):
            return now


def greedy_matching(pairs: DataFrame, by: str, weight: str) -> DataFrame:
    """The pairs (by, i, j, ...) that a greedy one-to-one choice takes: the heaviest first, then by i and j.

    In each round the pairs that are the best of both their ends are taken, and all others at these ends go; this
    takes the same pairs as going through them in order.
    """
    left = checkpointed(pairs)
    taken = left.limit(0)
    order = F.struct((-F.col(weight)).alias("w"), "i", "j")
    while left.take(1):
        ends = left.select(by, F.explode(F.array("i", "j")).alias("node"), order.alias("o"))
        best = ends.groupBy(by, "node").agg(F.min("o").alias("o"))
        both = best.groupBy(by, "o").agg(F.count("*").alias("n")).where("n = 2").select(by, F.col("o.i").alias("i"), F.col("o.j").alias("j"))
        won = checkpointed(left.join(both, [by, "i", "j"], "left_semi"))
        used = won.select(by, F.explode(F.array("i", "j")).alias("node"))
        for end in ("i", "j"):
            left = left.join(used.withColumnRenamed("node", end), [by, end], "left_anti")
        left, taken = checkpointed(left.select(pairs.columns)), taken.unionByName(won)
    return taken


def cycles(following: DataFrame, by: str) -> DataFrame:
    """by, node, label: the smallest node of the cycle of each node, for following (by, node, next), a permutation.

    Pointers double in every round, so rounds grow with the logarithm of the longest cycle.
    """
    now = checkpointed(following.select(by, "node", "next", F.col("node").alias("label")))
    while True:
        ahead = now.select(by, F.col("node").alias("next"), F.col("next").alias("_n"), F.col("label").alias("_l"))
        new = checkpointed(now.join(ahead, [by, "next"]).select(by, "node", F.col("_n").alias("next"), F.least("label", "_l").alias("label"), F.col("label").alias("_old")))
        now = new.drop("_old")
        if not new.where("label <> _old").take(1):
            return now.drop("next")
