"""Connected components by alternating large-star and small-star rounds (DataFrame operations only).

Every round moves edges, never adjacency lists: the minimum of a node's neighbours comes from a partial
aggregate, so a hub with very many edges costs one row per task. Each round's edges are written to the
shared folder, which cuts lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweepline.llm.common import discard, release_memory, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.withColumnRenamed("m", "v")).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal edge sets."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge, as a written table; component is the smallest node reachable.

    edges has two columns of one orderable type. Loops, repeated edges and edges with a null end are
    ignored. No edges give an empty table. Rounds grow with the logarithm of the longest path; more than ``max_rounds``
    end in RuntimeError.
    """
    spark = edges.sparkSession
    release_memory(spark)  # what led to the edges is written, so its shuffles can go
    a, b = edges.columns
    now = (
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    now, path = written(now, "cc-edges")
    if not now.take(1):
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    seen = _mark(now)
    for _ in range(max_rounds):
        following, new_path = written(_small_star(_large_star(now)), "cc-edges")
        mark = _mark(following)
        discard(spark, path)
        now, path = following, new_path
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    found, _ = written(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "components")
    discard(spark, path)
    # the rounds are some dozens of queries, whose plans and code the driver has compiled
    release_memory(spark)
    return found
