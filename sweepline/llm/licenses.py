"""Licence scans by canonical digest lookup (DataFrame operations only).

A text is brought to a canonical form: lower case, copyright lines left out, equivalent spellings made one,
punctuation and white space made single spaces. Its SHA-256 digest is joined with the digests of known licences' entire
texts. So is that of every run of paragraphs inside a text that can be one of these: runs are looked up where the first
paragraph is the first one of a known text, with as many paragraphs as that text has. So a whole licence, in its own layout
or as one paragraph, that stands in a longer text is found as well; of a licence that a text splits in another way, only
runs of the known counts are looked up.

Beside whole texts, ``notices`` are lines that put a work under a licence by title (``Licensed under ...``,
``SPDX-License-Identifier: ...``): the line without that beginning is looked up among the digests of titles.

Defined results: a null text is empty; an empty canonical form matches nothing; of several matches in a
document each licence is named once, in order; extra columns are ignored, repeated rows keep their own rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sweepline.llm.common import sha256_hex, text_of
from sweepline.llm.license_texts import DIGESTS, LICENSES, TITLES

#: Fixed values: (pattern on the lower-cased text, its one spelling). Patterns are of Java and RE2 alike.
SPELLINGS = (
    ("licence", "license"),
    ("sub-licen", "sublicen"),
    ("https://", "http://"),
    ("&", " and "),
    ("non-commercial", "noncommercial"),
    ("per cent", "percent"),
    ("copyright holders?|copyright owners?", "copyright holder"),
    ("behaviour", "behavior"),
    ("whilst", "while"),
)
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(copyright ?(\(c\)|©|[0-9])|\(c\) ?[0-9]|©|all rights reserved)[^\n]*$"


def canonical_lines(text: Column) -> Column:
    """The canonical form of each line, lines kept apart."""
    form = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    for pattern, one in SPELLINGS:
        form = F.regexp_replace(form, pattern, one)
    return F.regexp_replace(form, r"[^\p{L}\p{N}\n]+", " ")


def canonical(lines: Column) -> Column:
    """One form of canonical_lines() for texts that differ in case, punctuation, copyright lines and spellings only."""
    return F.trim(F.regexp_replace(lines, r"\s+", " "))


#: The beginning of a notice in canonical form.
NOTICE = (
    r"^(((this|the) \p{L}+ )?((is|are) )?(licensed|released|distributed|published|available) under (the terms of )?(the )?|spdx license identifier )"
)


def parts_of(lines: str) -> Column:
    """The paragraphs of canonical_lines() that have words, each in canonical form."""
    return F.filter(F.transform(F.split(lines, r"\n\s*\n"), canonical), lambda x: x != "")


def known_texts(spark: SparkSession, licenses: Mapping[str, str] = LICENSES, digests: Sequence[tuple] = DIGESTS) -> DataFrame:
    """license, k (paragraphs), head (digest of the first one), digest of the known texts; of equal texts the first name counts."""
    texts = spark.createDataFrame(sorted(licenses.items()), "license string, text string").withColumn("lines", canonical_lines(F.col("text")))
    parts = texts.select("license", parts_of("lines").alias("parts"))
    short = parts.select(
        "license",
        F.size("parts").alias("k"),
        sha256_hex(F.col("parts")[0]).alias("head"),
        sha256_hex(F.array_join("parts", " ")).alias("digest"),
    )
    both = short.unionByName(spark.createDataFrame(digests, "license string, k int, head string, digest string"))
    # a licence as one paragraph
    whole = both.select("license", F.lit(1).alias("k"), F.col("digest").alias("head"), "digest")
    return both.unionByName(whole).groupBy("k", "head", "digest").agg(F.min("license").alias("license"))


def known_titles(spark: SparkSession) -> DataFrame:
    """digest, license of the titles."""
    rows = [(k, t) for k, titles in sorted(TITLES.items()) for t in (k, *titles)]
    titles = spark.createDataFrame(rows, "license string, title string")
    digest = sha256_hex(F.regexp_replace(canonical(canonical_lines(F.col("title"))), " license$", ""))
    return titles.groupBy(digest.alias("digest")).agg(F.min("license").alias("license"))


def _literal_map(rows: list[tuple[str, Column]]) -> Column:
    return F.create_map(*[x for key, value in rows for x in (F.lit(key), value)])


def scan(docs: DataFrame, licenses: Mapping[str, str] = LICENSES, digests: Sequence[tuple] = DIGESTS) -> DataFrame:
    """doc_id, digest (of the canonical whole text), license (of the whole text or null), parts, notices (array<string>).

    parts names the licences whose whole texts stand in the text, notices those named by its notice lines.
    """
    # the known texts and titles are fixed tables of a few rows for each licence
    known = known_texts(docs.sparkSession, licenses, digests).orderBy("head", "k", "digest").collect()
    heads: dict[str, list[Column]] = {}
    for r in known:
        heads.setdefault(r["head"], []).append(F.struct(F.lit(r["k"]).alias("k"), F.lit(r["digest"]).alias("digest"), F.lit(r["license"]).alias("license")))
    by_head = _literal_map([(h, F.array(*of)) for h, of in heads.items()])
    of_texts = _literal_map([(d, F.lit(x)) for d, x in sorted({r["digest"]: r["license"] for r in known}.items())])
    of_titles = _literal_map([(r["digest"], F.lit(r["license"])) for r in known_titles(docs.sparkSession).orderBy("digest").collect()])
    lines = docs.select("doc_id", canonical_lines(text_of()).alias("lines"))
    rows = lines.select("doc_id", "lines", parts_of("lines").alias("pieces"))

    def run_at(piece: Column, i: Column) -> Column:
        """The licences whose texts begin at paragraph i (from 0)."""
        fits = lambda c: sha256_hex(F.array_join(F.slice("pieces", i + 1, c["k"]), " ")) == c["digest"]
        return F.transform(F.filter(F.coalesce(F.try_element_at(by_head, sha256_hex(piece)), F.array()), fits), lambda c: c["license"])

    title = lambda x: F.regexp_replace(F.regexp_replace(x, NOTICE, ""), " license$", "")
    notices = F.filter(F.transform(F.split("lines", "\n"), canonical), lambda x: x.rlike(NOTICE))
    whole = F.array_join("pieces", " ")
    digest = F.when(whole != "", sha256_hex(whole))
    named = lambda x: F.array_sort(F.array_distinct(F.array_compact(x)))
    return rows.select("doc_id", digest.alias("digest"), "pieces", "lines").select(
        "doc_id",
        "digest",
        F.try_element_at(of_texts, F.coalesce("digest", F.lit(""))).alias("license"),
        named(F.flatten(F.transform("pieces", run_at))).alias("parts"),
        named(F.transform(notices, lambda x: F.try_element_at(of_titles, sha256_hex(title(x))))).alias("notices"),
    )
