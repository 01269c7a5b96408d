"""Fixtures for the tests of this folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SF = "/root/testdata/sf0.001"

EDGE_TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "One two three four",
    "a b c d e f g h i j k l m n o p",
    "A B c d e f g h i j k l m n o p",
    "a b c d e f g h i j k l m n o p",
    "x" * 5000,
    "don't it's 12,5 éè 你好 \U0001f600  \n\n  end of it",
    "word " * 3000,
]


def edge_docs(spark: SparkSession, extra: bool = True) -> DataFrame:
    """Nulls, empty and long texts, ties, repeated rows and a clashing extra column."""
    rows = [(i, t, None if i % 3 == 0 else f"src{i % 2}") for i, t in enumerate(EDGE_TEXTS)]
    rows += [rows[5], rows[7], (None, "a null id", "src1"), (4, "another text with the same id", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    if extra:
        df = df.selectExpr("*", "'x' as node", "'y' as key", "1 as score", "2 as tokens")
    return df


def no_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def sample_docs(spark: SparkSession) -> DataFrame:
    return spark.read.parquet(f"{SF}/documents.parquet")
