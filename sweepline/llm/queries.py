"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sweepline.llm import (
    byte_bpe, chat_format, embedding_dedup, fingerprint, hard_negatives, licenses, lm_scoring, media, mixing, near_dedup, oracles,
    prefix_trie, toxicity, url_filter,
)
from sweepline.session import table

#: The conversation that every run of op4 formats besides those of the table.
EXTRA_TEXT = "\\### Assistant: </turn> ok"


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.decode_media(media.store_payloads(table(spark, sf_dir, "documents"))))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_corpus(table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame(
        [(-7, 0, "user", EXTRA_TEXT), (-7, 1, "assistant", EXTRA_TEXT)],
        "conv_id long, turn long, role string, text string",
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.digests(chat_format.format_conversations(rows))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = byte_bpe.public_vocabulary()
    encoded = byte_bpe.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), *vocabulary)
    return byte_bpe.decode_documents(encoded, *vocabulary).select(
        "doc_id",
        byte_bpe.n_tokens().alias("n_tokens"),
        F.sha2("tokens", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("parts", "notices")})


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_fingerprint, op2_media, op3_lm_score, op4_chat_format, op5_near_dedup,
        op6_mix, op7_toxicity, op8_byte_bpe, op9_url_filter, op10_licenses, op11_prefix_trie, op12_hard_negatives, op13_embedding_dedup,
    )
}

#: Hashes, codecs and trained models are outside SQL; near-duplicates are too slow in it over whole tables.
ORACLE_SQL: dict[str, str] = {
    "op4_chat_format": oracles.chat(EXTRA_TEXT),
    "op9_url_filter": oracles.urls(),
    "op10_licenses": oracles.licenses(),
    "op11_prefix_trie": oracles.trie(),
    "op12_hard_negatives": oracles.negatives(),
    "op13_embedding_dedup": oracles.embedding_groups(),
}
