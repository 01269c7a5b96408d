"""The fixed tables seen as clouds, tracks and jobs, in Spark and in SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sweepline.session import table


def micros(ts: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as points of sessions."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("session"),
        F.col("l_quantity").alias("x"),
        (F.col("l_extendedprice") / 1000).alias("y"),
        (F.col("l_discount") * 100).alias("z"),
        micros("l_shipdate").alias("t"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    )


CLOUD = """cloud as (select l_returnflag as session, l_quantity as x, l_extendedprice / 1000 as y, l_discount * 100 as z,
  epoch_us(l_shipdate) as t, l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem)"""
ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as points of streams."""
    part = lambda i: F.element_at("embedding", i).cast("double")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), part(1).alias("x"), part(2).alias("y"), part(3).alias("z"), F.col("label").alias("stream")
    )


VECTORS = """vectors as (select vec_id as id, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z,
  label as stream from embeddings)"""


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as tracks of users."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", micros("ts").alias("t"), "event_type", "value")


TRACK = "track as (select event_id, user_id, epoch_us(ts) as t, event_type, value from events)"
