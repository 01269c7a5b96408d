"""The corpus pipeline: toxic documents go, one of each near-duplicate group stays, sources are mixed, texts are encoded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sweepline.llm import byte_bpe, mixing, near_dedup, toxicity
from sweepline.llm.common import discard, free_name, text_of, written
from sweepline.session import table

#: A stage links at 0.8; the query op5_near_dedup has a threshold of its own.
NEAR = near_dedup.Parameters(percent=80)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the rows that the model, fitted on the labels, does not predict toxic, whatever their doc_id.

    A null text is scored as an empty one; rows with equal texts have one decision; without labels of both classes all stay.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    name = free_name("score", docs.columns)
    return toxicity.score_documents(docs, model, name).where(F.col(name) < 0.5).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each group at a similarity of 0.8 or more, one row of it.

    Rows without doc_id stay, and so do documents without words; of rows that repeat a doc_id any one stays.
    """
    decided = near_dedup.near_duplicates(docs, NEAR)
    kept = decided.where("kept").groupBy("doc_id").agg(F.count("*").alias("rows"))
    stays = docs.join(kept.where("rows = 1").select("doc_id"), "doc_id", "left_semi")
    again = docs.join(kept.where("rows > 1 and doc_id is not null").select("doc_id"), "doc_id", "left_semi")
    return stays.unionByName(again.dropDuplicates(["doc_id"])).unionByName(docs.where("doc_id is null")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their ``position`` in the mixture, in that order over the files and inside each.

    Readers of several files do not keep an order, so it is the column that says it. It rises along the mixture
    and is unique; it has gaps where a source's last block isn't full. Where docs has a column of that name, the
    position's name ends in ``_``. A null source is a source of its own; rows without doc_id and rows that repeat one have
    places of their own.
    """
    p = mixing.Parameters()
    free = free_name("position", docs.columns)
    # rows without doc_id are told apart by their texts
    key = F.coalesce("doc_id", F.xxhash64(text_of()))
    source = F.coalesce(F.col("source").cast("string"), F.lit(mixing.NULL_SOURCE))
    mixed = mixing.mix(docs.select(key.alias("doc_id"), "source"), p)
    at = F.col("slot") * p.block + F.col("place")
    # rows of one key meet its places in the order of their sources
    order = mixed.groupBy(F.col("doc_id").alias("key")).agg(F.sort_array(F.collect_list(F.struct("source", at.alias("at")))).alias("places"))
    rows = docs.select(key.alias("key"), source.alias("by"), F.xxhash64(text_of()).alias("then"), F.struct(*docs.columns).alias("row"))
    nth = F.row_number().over(Window.partitionBy("key").orderBy("by", "then"))
    placed = rows.withColumn("nth", nth).join(order, "key", "left")
    placed, _ = written(placed.select("row", F.try_element_at("places", F.col("nth"))["at"].alias("at")), "mix-placed")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return placed.repartitionByRange(parts, "at").sortWithinPartitions("at").select("row.*", F.col("at").alias(free))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, in place of the text, and their number; the position in the mixture stays.

    A null text has no tokens. Where docs has a column tokens or n_tokens, the new one's name ends in ``_``.
    """
    encoded = byte_bpe.encode_documents(docs, *byte_bpe.public_vocabulary())
    return encoded.withColumn(free_name("n_tokens", encoded.columns), byte_bpe.n_tokens(encoded.columns[-1]))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: No stage but the mixing could be said in SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
