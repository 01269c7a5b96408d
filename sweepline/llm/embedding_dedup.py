"""Near-duplicate embeddings: tiles of rows in the order of their principal axes, compared leading axes first.

1. Rows with equal label and vector are one class; a class carries its number of rows and its smallest vec_id.
2. The second moments of all unit vectors, summed in Spark, give the axes (d x d numbers, d the vectors' length).
3. Classes of one label are cut into tiles of at most about ``rows`` classes along the first axis; a crowded cell is split by
   hash. Two tiles are compared only if the boxes of their leading coordinates come as near as the threshold asks for.
4. Inside a pair of tiles products are summed axis by axis. What is still to come is at most the product of the two suffix norms,
   so a pair goes as soon as sum and bound stay below the threshold. What is left is checked on the vectors themselves.
5. A pair of tiles gives the numbers of links by class and a forest of its links, never the links: dense groups stay linear.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sweepline.llm.common import bounded_batches, result, scratch, written
from sweepline.llm.components import connected_components

#: Rounding of rotated products: a pair is dropped only if it misses the threshold by more than this.
SLACK = 1e-9


@dataclass(frozen=True)
class Parameters:
    cosine: float = 0.93
    #: Classes in a tile.
    rows: int = 2048
    #: Leading coordinates of a tile's box.
    box: int = 4
    #: Cells of the first axis between -1 and 1.
    cells: int = 256
    #: Axes after which pairs are tested.
    steps: tuple[int, ...] = (8, 16, 24, 32, 48)


def valid_vector(column: str = "embedding"):
    """Not null, without null or non-finite components, not zero."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(column, lambda x: x != 0), F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of an array column as doubles, scaled by powers of two (exactly) so that squares neither overflow nor vanish."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(flat.offsets.to_numpy())
    width = width or int(sizes.max(initial=0))
    out = np.zeros((len(flat), width))
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out[np.arange(width)[None, :] < sizes[:, None]] = values
    _, exponent = np.frexp(np.abs(out).max(axis=1, initial=0.0))
    return np.ldexp(out, -exponent[:, None])


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def principal_axes(classes: DataFrame, width: int) -> np.ndarray:
    """Orthonormal axes as columns, the one with most energy first, from the second moments of all rows."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            v = unit(matrix(batch.column("v"), width))
            total += v.T @ v
        yield pa.RecordBatch.from_pydict({"i": np.arange(width, dtype=np.int32), "row": list(total)})

    parts = classes.select("v").mapInArrow(moments, "i int, row array<double>")
    sums = parts.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    second = np.zeros((width, width))
    for r in sums:
        second[r.i, r.j] = r.x
    energy, axes = np.linalg.eigh((second + second.T) / 2)
    return np.ascontiguousarray(axes[:, np.argsort(-energy, kind="stable")])


def linked_pairs(a: np.ndarray, b: np.ndarray, axes: np.ndarray, p: Parameters, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i of a, j of b) of all pairs at the threshold; with ``same``, i < j."""
    width = axes.shape[1]
    steps = [*(s for s in p.steps if s < width), width]
    least = p.cosine - SLACK
    ra, rb = unit(a) @ axes, unit(b) @ axes
    suffix = lambda r, k: np.sqrt(np.maximum(0.0, np.einsum("ij,ij->i", r[:, k:], r[:, k:])))
    left, right = [suffix(ra, k) for k in steps], [suffix(rb, k) for k in steps]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for start in range(0, len(a), 512):
        rows = slice(start, min(start + 512, len(a)))
        sums = ra[rows, : steps[0]] @ rb[:, : steps[0]].T
        alive = sums + left[0][rows, None] * right[0][None, :] >= least
        if same:
            alive &= np.arange(rows.start, rows.stop)[:, None] < np.arange(len(b))[None, :]
        n = 1
        while n < len(steps) and alive.mean() > 0.1:  # many are left: go on with whole blocks
            part = slice(steps[n - 1], steps[n])
            sums += ra[rows, part] @ rb[:, part].T
            alive &= sums + left[n][rows, None] * right[n][None, :] >= least
            n += 1
        i, j = np.nonzero(alive)
        score = sums[i, j]
        i += rows.start
        for n in range(n, len(steps)):
            if not len(i):
                break
            part = slice(steps[n - 1], steps[n])
            score = score + np.einsum("ij,ij->i", ra[i, part], rb[j, part])
            stays = score + left[n][i] * right[n][j] >= least
            i, j, score = i[stays], j[stays], score[stays]
        for at in range(0, len(i), 65536):
            x, y = a[i[at : at + 65536]], b[j[at : at + 65536]]
            norms = np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y))
            stays = np.einsum("ij,ij->i", x, y) / norms >= p.cosine
            found.append((i[at : at + 65536][stays], j[at : at + 65536][stays]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def smallest_reachable(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """By node of n, the smallest node that links (i, j) reach."""
    low = np.arange(n)
    while True:
        least = np.minimum(low[i], low[j])
        new = low.copy()
        np.minimum.at(new, low[i], least)
        np.minimum.at(new, low[j], least)
        new = new[new]
        if np.array_equal(new, low):
            return low
        low = new


def near_duplicates(vectors: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    n_links counts the other rows at ``p.cosine`` or more, copies included; component_id is the smallest vec_id that links reach.
    Rows link only where labels are equal and not null and vectors equally long. A row whose label or vec_id is null, or whose
    vector is null, empty, zero or holds a null or non-finite component, links with nothing and is kept. Rows that repeat
    a vec_id are rows of their own and linked only if their vectors are. Further columns are ignored; an empty table gives an
    empty table. The search is exact; its work grows with the square of a label's classes, less what boxes and bounds save.
    """
    spark = bounded_batches(vectors.sparkSession, size="16m")
    takes_part = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & valid_vector()
    rows = vectors.select("vec_id", "label", F.when(takes_part, F.col("embedding")).cast("array<double>").alias("v"))
    tag = lambda seed: F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(seed), "label", "v"))
    rows = rows.select("*", tag(1).alias("tag"), tag(2).alias("tag2"))
    with scratch(spark):
        classes = rows.where("v is not null").groupBy("tag", "tag2").agg(
            F.first("label").alias("label"), F.first("v").alias("v"), F.min("vec_id").alias("least"), F.count("*").alias("n")
        )
        classes, _ = written(classes, "classes")
        width = classes.agg(F.max(F.size("v"))).first()[0]
        if width is None:
            found = None
        else:
            links, _ = written(_tile_links(classes, principal_axes(classes, width), width, p), "links")
            counts = links.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
            parts = connected_components(links.where("other is not null").select("node", "other"))
            node = F.struct("least", "tag", "tag2").alias("node")
            found = (
                classes.select("tag", "tag2", "n", node)
                .join(counts, "node", "left")
                .join(parts, "node", "left")
                .select(
                    "tag", "tag2",
                    (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                    F.coalesce("component.least", "node.least").alias("component_id"),
                )
            )
            found = result(found, "embedding-classes")
    keys = rows.select("vec_id", "tag", "tag2")
    if found is None:
        keys = keys.withColumns({"n_links": F.lit(0).cast("long"), "component_id": F.lit(None).cast("long")})
    else:
        keys = keys.join(found, ["tag", "tag2"], "left")
    component = F.coalesce("component_id", "vec_id").cast("long")
    return keys.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def _tile_links(classes: DataFrame, axes: np.ndarray, width: int, p: Parameters) -> DataFrame:
    """Rows (node, links) with the weighted number of links inside one pair of tiles, and rows (node, other) of its forest."""
    group = ["label", "size"]
    lead = axes[:, : p.box]

    def led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = unit(matrix(batch.column("v"), width)) @ lead
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(at), pa.list_(pa.float64()))], [*batch.schema.names, "lead"])

    named = classes.select(
        "label", F.size("v").alias("size"), F.struct("least", "tag", "tag2").alias("node"), "n", "v"
    )
    placed = named.mapInArrow(led, "label int, size int, node struct<least: bigint, tag: bigint, tag2: bigint>, n bigint, v array<double>, lead array<double>")
    placed = placed.withColumn("cell", F.floor(F.col("lead")[0] * (p.cells // 2)).cast("int"))
    cells = placed.groupBy(*group, "cell").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy(*group).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    splits = F.ceil(F.col("rows") / p.rows).cast("int")
    cells = cells.select(*group, "cell", F.floor(F.coalesce(before, F.lit(0)) / p.rows).alias("first"), splits.alias("splits"))
    salt = F.pmod(F.xxhash64("node"), F.col("splits"))
    placed = placed.join(cells, [*group, "cell"]).withColumn("tile", F.col("first") * 2 + (F.col("splits") > 1).cast("int") + 2 * salt)
    tiles = placed.groupBy(*group, "tile").agg(
        F.collect_list(F.struct("node", "n", "v")).alias("members"),
        *(F.min(F.col("lead")[k]).alias(f"lo{k}") for k in range(lead.shape[1])),
        *(F.max(F.col("lead")[k]).alias(f"hi{k}") for k in range(lead.shape[1])),
    )
    tiles, _ = written(tiles, "tiles")
    boxes = tiles.drop("members")
    a, b = boxes.alias("a"), boxes.alias("b")
    gap = lambda k: F.greatest(F.col(f"a.lo{k}") - F.col(f"b.hi{k}"), F.col(f"b.lo{k}") - F.col(f"a.hi{k}"), F.lit(0.0))
    apart = sum((gap(k) * gap(k) for k in range(lead.shape[1])), F.lit(0.0))
    near = (F.col("a.label") == F.col("b.label")) & (F.col("a.size") == F.col("b.size")) & (F.col("a.tile") <= F.col("b.tile"))
    pairs = a.join(b, near & (apart <= 2 - 2 * p.cosine + SLACK)).select("a.label", "a.size", F.col("a.tile").alias("tile"), F.col("b.tile").alias("tile_b"))
    members = tiles.select(*group, "tile", "members")
    pairs = pairs.join(members, [*group, "tile"]).join(
        members.select(*group, F.col("tile").alias("tile_b"), F.col("members").alias("members_b")), [*group, "tile_b"]
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                same = batch.column("tile")[k] == batch.column("tile_b")[k]
                one, two = (batch.column(c)[k].values for c in ("members", "members_b"))
                i, j = linked_pairs(*(matrix(x.field("v"), width) for x in (one, two)), axes, p, same)
                if not len(i):
                    continue
                nodes = pa.concat_arrays([one.field("node"), two.field("node")])
                weights = np.concatenate([x.field("n").to_numpy() for x in (one, two)])
                base = 0 if same else len(one)
                low = smallest_reachable(len(nodes), i, j + base)
                links = np.bincount(i, weights[j + base], len(nodes)) + np.bincount(j + base, weights[i], len(nodes))
                counted, joined = np.nonzero(links)[0], np.nonzero(low != np.arange(len(nodes)))[0]
                empty = pa.nulls(len(counted), nodes.type)
                yield pa.RecordBatch.from_pydict({
                    "node": pa.concat_arrays([nodes.take(pa.array(counted)), nodes.take(pa.array(joined))]),
                    "other": pa.concat_arrays([empty, nodes.take(pa.array(low[joined]))]),
                    "links": np.concatenate([links[counted].astype(np.int64), np.zeros(len(joined), np.int64)]),
                })

    node_type = "struct<least: bigint, tag: bigint, tag2: bigint>"
    return pairs.select("tile", "tile_b", "members", "members_b").mapInArrow(compare, f"node {node_type}, other {node_type}, links bigint")
