"""The trie of conversation prefixes, by way of its Patricia tree.

1. A turn becomes 16 bytes of the SHA-256 of its role and text, a conversation the bytes of its turns in a row, so that the order of
   bytes is the order of the turns and equal conversations are equal bytes. Texts go no further than this.
2. Equal conversations become one path with their number and least id; their ids stay in sorted pieces, one for each range of ids.
3. Paths are sorted over all partitions. Each partition walks its own once, with a stack: the common prefix with the path before
   tells where branches are. Only branches, ends and leaves become nodes, each with one edge of several turns.
4. Nodes that several partitions share lie on the paths at the partitions' borders. There every depth is a node, and their sums
   are put together by key: all sums are additive, since a node belongs to the partition in which it begins.
5. The edges' inner nodes, which have one child each, come last: they repeat their lower end's numbers, and the
   tokens that they save follow from the edge's suffix sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sweepline.llm.common import bounded_batches, result, scratch, scratch_root, written

#: Bytes of a turn in a path.
TURN = 16
WORD = r"[^\x20\x09-\x0D]+"
KINDS = {"binary": pa.binary(), "bigint": pa.int64(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64()), "boolean": pa.bool_()}
#: Columns of a node of the compressed tree.
NODE = {
    "key": "binary", "parent": "binary", "depth": "bigint", "top": "bigint", "conv_id": "bigint", "n_convs": "bigint", "n_children": "bigint",
    "n_leaves": "bigint", "all_words": "bigint", "own_words": "bigint", "before": "bigint", "ends": "string", "suffix": "array<bigint>", "shared": "boolean",
}


@dataclass(frozen=True)
class Parameters:
    #: Conversation c begins with turns of conversation c - c % family.
    family: int = 20
    #: It takes crc32(c) % heads of them.
    heads: int = 4
    #: Ids of one piece of a path's members.
    ids: int = 4096


# ---- conversations as paths ------------------------------------------------------------------------------------


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turns) with the turns in order, each (turn, role, digest, words); one conversation is one row, 16 bytes a turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.substring(F.sha2(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), "UTF-8"), 256), 1, 2 * TURN))
    turn = F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    return (
        rows.where("conv_id is not null")
        .groupBy(F.col("conv_id").cast("long").alias("conv_id"))
        .agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    )


def rebuilt(convs: DataFrame, p: Parameters) -> DataFrame:
    """(conv_id, path, words): the first turns of the family's first conversation, then the conversation's own after as many."""
    n = F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % p.heads
    first = convs.where(F.col("conv_id") % p.family == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, p.heads - 1).alias("head"))
    own = convs.select("*", (F.col("conv_id") - F.col("conv_id") % p.family).alias("base"), n.cast("int").alias("n"))
    none = F.expr("slice(turns, 1, 0)")
    turns = F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("n")), F.slice("turns", F.col("n") + 1, F.greatest(F.size("turns") - F.col("n"), F.lit(0))))
    both = own.join(first, "base", "left").select("conv_id", turns.alias("turns"))
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    return both.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["words"]).alias("words"))


def sorted_paths(convs: DataFrame, p: Parameters) -> DataFrame:
    """Pieces of paths' members in the order of paths, checkpointed, so that partitions and their order stay."""
    spark = convs.sparkSession
    pieces = convs.groupBy("path", F.floor(F.col("conv_id") / p.ids).alias("piece")).agg(
        F.count("*").alias("n"),
        F.min("conv_id").alias("least"),
        F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"),
        F.first("words").alias("words"),
    )
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    scratch_root(spark)
    return pieces.repartitionByRange(parts, "path").sortWithinPartitions("path", "piece").checkpoint()


def common_turns(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b)) // TURN
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[: middle * TURN] == b[: middle * TURN] else (low, middle - 1)
    return low


def borders(paths: DataFrame) -> dict[int, tuple[int, int, bool]]:
    """By partition: turns shared with the path before its first and with the path after its last, and whether it is the first.

    One small row for each partition; the paths themselves are compared in Spark.
    """
    ends = paths.groupBy(F.spark_partition_id().alias("part")).agg(F.min("path").alias("first"), F.max("path").alias("last"))
    order = Window.orderBy("part")
    beside = ends.select("part", "first", "last", F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("after"))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                left = 0 if r["before"] is None else common_turns(r["before"], r["first"])
                right = 0 if r["after"] is None else common_turns(r["last"], r["after"])
                yield pa.RecordBatch.from_pydict({"part": [r["part"]], "left": [left], "right": [right], "begins": [r["before"] is None]})

    rows = beside.mapInArrow(compared, "part bigint, left bigint, right bigint, begins boolean").collect()
    return {r.part: (r.left, r.right, r.begins) for r in rows}


# ---- the walk over one partition -------------------------------------------------------------------------------


@dataclass
class Node:
    depth: int
    #: It begins in this partition.
    owned: bool
    n: int = 0
    least: int | None = None
    children: int = 0
    leaves: int = 0
    #: Words of all members' whole paths; words of the distinct nodes strictly below.
    all_words: int = 0
    below: int = 0
    ends: str | None = None


@dataclass
class Path:
    path: bytes = b""
    #: Words of the first d turns.
    words: list[int] = field(default_factory=lambda: [0])
    n: int = 0
    least: int | None = None
    digest: object = None


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[Path]:
    """Whole paths of sorted pieces; ids are hashed piece by piece."""
    now: Path | None = None
    for batch in batches:
        for path, n, least, ids, words in zip(*(batch.column(c).to_pylist() for c in ("path", "n", "least", "ids", "words")), strict=True):
            if now is None or now.path != path:
                if now is not None:
                    yield now
                sums = [0]
                for w in words:
                    sums.append(sums[-1] + w)
                now = Path(path, sums, n, least, hashlib.sha256(ids.encode()))
            else:
                now.n, now.least = now.n + n, min(now.least, least)
                now.digest.update(b"," + ids.encode())
    if now is not None:
        yield now


class Walk:
    """Nodes of one partition's paths, in the order in which they close."""

    def __init__(self, left: int, right: int, begins: bool, goes_on: bool) -> None:
        self.left, self.right, self.begins, self.goes_on = left, right, begins, goes_on
        self.shared_to = -1
        self.stack: list[Node] = []
        self.at = Path()
        self.out: list[dict] = []

    def key(self, depth: int) -> bytes:
        return hashlib.blake2b(self.at.path[: depth * TURN], digest_size=16).digest()

    def close(self, parent: Node | None) -> None:
        """Take the last node of the stack, which lies on the path ``at``, into its parent."""
        node, w = self.stack.pop(), self.at.words
        top = parent.depth + 1 if parent else 0
        own = w[node.depth] - w[node.depth - 1] if node.depth else 0
        before = w[node.depth - 1] if node.depth else 0
        if parent:
            parent.n += node.n
            parent.least = node.least if parent.least is None else min(parent.least, node.least)
            parent.leaves += node.leaves
            parent.all_words += node.all_words
            parent.children += node.owned
            parent.below += node.below + (w[node.depth] - w[parent.depth] if node.owned else 0)
        self.out.append({
            "key": self.key(node.depth), "parent": self.key(parent.depth) if parent else None, "depth": node.depth, "top": top,
            "conv_id": node.least, "n_convs": node.n, "n_children": node.children, "n_leaves": node.leaves, "all_words": node.all_words,
            "own_words": node.below + (own if node.owned else 0), "before": before, "ends": node.ends,
            "suffix": [before - w[d - 1] if d else 0 for d in range(top, node.depth + 1)],
            "shared": node.depth == 0 or not node.owned or node.depth <= self.shared_to,
        })

    def rise(self, depth: int) -> None:
        """Close all nodes below depth; the path that follows branches off there."""
        while self.stack[-1].depth > depth:
            under = self.stack[-2]
            if under.depth < depth:
                under = Node(depth, True)
                self.stack.insert(-1, under)
            self.close(under)

    def take(self, path: Path) -> None:
        depth = len(path.path) // TURN
        if not self.stack:  # every depth that the partition before has too is a node
            self.stack = [Node(d, self.begins) for d in range(self.left + 1)]
            if depth > self.left:
                self.stack.append(Node(depth, True))
        else:
            shared = common_turns(self.at.path, path.path)
            self.rise(shared)
            if depth > shared:
                self.stack.append(Node(depth, True))
        self.at, end = path, self.stack[-1]
        end.n, end.least, end.ends = path.n, path.least, path.digest.hexdigest()
        end.all_words, end.leaves = path.n * path.words[depth], 1

    def continued(self, path: Path) -> None:
        """The path before goes on in this one: it is no leaf."""
        if path.path.startswith(self.at.path):
            self.stack[-1].leaves = 0

    def finish(self) -> None:
        """Close what is open; every depth that the partition after has too is a node."""
        if self.goes_on and self.right * TURN == len(self.at.path):
            self.stack[-1].leaves = 0
        self.rise(self.right)
        self.shared_to = self.right
        while len(self.stack) > 1 or self.stack[-1].depth:
            if self.stack[-2].depth < self.stack[-1].depth - 1:
                self.stack.insert(-1, Node(self.stack[-1].depth - 1, True))
            self.close(self.stack[-2])
        self.close(None)


def patricia_nodes(paths: DataFrame) -> DataFrame:
    """Nodes of the compressed tree with their sums, those that partitions share put together."""
    edges = borders(paths)
    last = max(edges, default=-1)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        if part not in edges:
            return
        tree, schema = Walk(*edges[part], part != last), pa.schema([(n, KINDS[k]) for n, k in NODE.items()])
        for path in _paths(batches):
            if tree.stack:
                tree.continued(path)
            tree.take(path)
            if len(tree.out) >= 2048:
                yield pa.RecordBatch.from_pylist(tree.out, schema)
                tree.out = []
        tree.finish()
        yield pa.RecordBatch.from_pylist(tree.out, schema)

    nodes, _ = written(paths.mapInArrow(walk, ", ".join(f"{n} {k}" for n, k in NODE.items())), "nodes")
    one = [F.first(c, ignorenulls=True).alias(c) for c in ("parent", "depth", "top", "before", "ends", "suffix")]
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "all_words", "own_words")]
    shared = nodes.where("shared").groupBy("key").agg(*one, *sums, F.min("conv_id").alias("conv_id"))
    columns = [c for c in nodes.columns if c != "shared"]
    return nodes.where("not shared").select(columns).unionByName(shared.select(columns))


def prefix_trie(rows: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are taken in the order of turn (null first), role and digest; null roles and texts are empty. Rows without conv_id take no part;
    repeated rows are turns of their own. A conversation whose rebuilt form has no turn is a member of the root alone. An
    empty table has no node. Further columns are ignored.
    """
    spark = bounded_batches(rows.sparkSession)
    with scratch(spark):
        paths = sorted_paths(rebuilt(conversations(rows), p), p)
        nodes, _ = written(patricia_nodes(paths), "tree")
        above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("above"))
        edges = nodes.join(above, "parent", "left")
        inner = edges.select("*", F.posexplode("suffix").alias("place", "rest"))
        top, end = F.col("place") == 0, F.col("place") == F.size("suffix") - 1
        at_end = lambda x, otherwise: F.when(end, x).otherwise(otherwise)
        # all words of members below or at the node, less one count of each distinct node
        saved = F.col("all_words") - F.col("n_convs") * F.col("before") - F.col("own_words")
        return result(inner.select(
            "conv_id",
            (F.col("top") + F.col("place")).alias("depth"),
            F.when(top, F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
            "n_convs",
            at_end(F.col("n_children"), F.lit(1)).cast("long").alias("n_children"),
            "n_leaves",
            (saved + (F.col("n_convs") - 1) * F.col("rest")).alias("saved_tokens"),
            F.coalesce(at_end(F.col("ends"), F.lit(None)), _empty()).alias("ends_sha256"),
        ), "trie")


def _empty() -> Column:
    return F.lit(hashlib.sha256(b"").hexdigest())
