"""Document fingerprints by a homomorphic multiset hash (DataFrame operations only).

A fingerprint is a vector of sums. Each paragraph (a line that isn't blank) adds 128 numbers of 32 bits, cut from eight
SHA-512 digests of it, modulo 2^32: two documents have equal sums if they have the same paragraphs, in any order, and a
paragraph is inserted or deleted by adding or subtracting its vector. At 4,096 bits a generalised birthday attack on the
sums is as hard as one on a 128-bit hash.

For likeness, each paragraph is cut into pieces (words, long ones every 12 characters), and each piece with the one before
it in the paragraph is an element. Hashes spread elements over four groups of 64 counters modulo 2^32, and add 64 bits
each to their group's. Twice a counter minus the group's elements is a random +1/-1 sum, so the cosine of two such
vectors estimates the cosine of the documents' element counts, with a noise of about 0.06. Elements lie inside paragraphs,
so these sums don't depend on the order of paragraphs either.

Defined results: a null text is empty; a text without paragraphs has the zero vector, whose likeness is 1 to
another zero vector and 0 to any other. For edited texts, rows that repeat a doc_id are in one place of the
order, and the smallest of their texts (by hash) stands for them as the next document; a null doc_id comes before all
others. A table of one document has that document as its own next one. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sweepline.llm.common import sha256_hex, text_of, written

DIGESTS, GROUPS = 8, 4
MASK = (1 << 32) - 1
NIBBLES, PAIRS = 0x1111111111111111, 15 | 15 << 32
PIECE = r"(\S{1,12})"


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"\S"))


def _numbers(n: int) -> Column:
    return F.array(*[F.lit(i) for i in range(n)])


def _exact(lines: Column) -> Column:
    """128 sums over the lines: those of number j of digest i, modulo 2^32.

    A number is the CRC-32 of four bytes of a digest: each such number is that of one four bytes only.
    """
    digests = lambda i: F.transform(lines, lambda x: F.unhex(F.sha2(F.encode(F.concat(i.cast("string"), F.lit(":"), x), "UTF-8"), 512)))
    number = lambda d, j: F.crc32(F.substr(d, j * 4 + 1, F.lit(4)))
    of = lambda ds: F.transform(_numbers(16), lambda j: F.aggregate(ds, F.lit(0).cast("long"), lambda a, d: a + number(d, j), lambda a: a.bitwiseAND(MASK)))
    return F.flatten(F.transform(F.transform(_numbers(DIGESTS), digests), of))


def _elements(lines: Column) -> Column:
    """A hash of each piece and the one before it."""
    pieces = F.transform(lines, lambda x: F.transform(F.regexp_extract_all(x, F.lit(PIECE), 1), lambda w: F.xxhash64(w)))
    paired = lambda p: F.zip_with(p, F.slice(F.concat(F.array(F.lit(0).cast("long")), p), F.lit(1), F.size(p)), lambda w, v: F.xxhash64(v, w))
    return F.flatten(F.transform(pieces, paired))


def _counters(elements: Column) -> Column:
    """Of each group: n, and 32 sums that hold two counters each.

    Bits are added 16 at a time in fields of 4 bits, over blocks of 7 elements (so that no sum reaches the sign), and these sums then in fields of 32 bits.
    """
    shifted = lambda h, i: F.call_function("shiftrightunsigned", h, i)
    nibbles = lambda block, i: F.aggregate(block, F.lit(0).cast("long"), lambda a, h: a + shifted(h, i).bitwiseAND(F.lit(NIBBLES)))
    blocks = lambda own: F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / 7).cast("int")), lambda b: F.slice(own, b * 7 + 1, F.lit(7)))
    fields = lambda sums: F.transform(F.sequence(F.lit(0), F.lit(28), F.lit(4)), lambda i: F.aggregate(sums, F.lit(0).cast("long"), lambda a, x: a + shifted(x, i).bitwiseAND(F.lit(PAIRS))))
    wide = lambda bs: F.flatten(F.transform(_numbers(4), lambda i: F.transform(F.array(F.transform(bs, lambda block: nibbles(block, i))), fields)[0]))
    of = lambda own: F.struct(
        F.size(own).cast("long").alias("n"),
        F.when(F.size(own) == 0, F.array_repeat(F.lit(0).cast("long"), 32)).otherwise(F.transform(F.array(blocks(own)), wide)[0]).alias("bits"),
    )
    # a hash of the hash chooses the group, so that all 64 bits are free to count
    group = lambda g: F.filter(elements, lambda h: F.pmod(F.hash(h), F.lit(GROUPS)) == g)
    return F.transform(F.transform(_numbers(GROUPS), group), of)


def vector(text: Column) -> Column:
    """struct<exact array<bigint>, groups array<struct<n, bits array<bigint>>>> of a text."""
    lines = F.array(paragraphs(text))  # a lambda's variable is computed once
    both = F.transform(lines, lambda x: F.struct(_exact(x).alias("exact"), F.transform(F.array(_elements(x)), _counters)[0].alias("groups")))
    return both[0]


def combined(x: Column, y: Column, sign: int = 1) -> Column:
    """The vector of both documents' paragraphs together, or (sign -1) of x without those of y."""
    return F.struct(
        F.zip_with(x["exact"], y["exact"], lambda a, b: (a + sign * b).bitwiseAND(MASK)).alias("exact"),
        F.zip_with(
            x["groups"],
            y["groups"],
            lambda g, h: F.struct((g["n"] + sign * h["n"]).alias("n"), F.zip_with(g["bits"], h["bits"], lambda a, b: a + sign * b).alias("bits")),
        ).alias("groups"),
    )


def printed(v: Column) -> Column:
    """A SHA-256 digest of the exact sums, the number of elements, and the start of one of the counters."""
    counters = F.transform(v["groups"], lambda g: F.array_join(F.transform(g["bits"], lambda a: a.cast("string")), ","))
    elements = F.aggregate(v["groups"], F.lit(0).cast("long"), lambda s, g: s + g["n"])
    return F.concat(
        F.sha2(F.array_join(F.transform(v["exact"], lambda a: a.cast("string")), ","), 256),
        F.lit("-"),
        elements.cast("string"),
        F.lit("-"),
        F.substr(F.sha2(F.array_join(counters, ","), 256), F.lit(1), F.lit(16)),
    )


def signs(groups: Column) -> Column:
    """struct<s array<double>, norm>: the +1/-1 sums of a vector's groups and their square."""
    of = lambda g: F.flatten(
        F.array(
            F.transform(g["bits"], lambda a: (2 * a.bitwiseAND(MASK) - g["n"]).cast("double")),
            F.transform(g["bits"], lambda a: (2 * F.shiftrightunsigned(a, 32) - g["n"]).cast("double")),
        )
    )
    sums = F.flatten(F.transform(groups, of))
    square = lambda s: F.aggregate(s, F.lit(0.0), lambda t, p: t + p * p)
    return F.transform(F.array(sums), lambda s: F.struct(s.alias("s"), square(s).alias("norm")))[0]


def likeness(x: Column, y: Column, same: Column) -> Column:
    """Estimated cosine, from 0 to 1, of two vectors' signs(); same: whether the fingerprints are equal."""
    dot = F.aggregate(F.zip_with(x["s"], y["s"], lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    cosine = dot / F.sqrt(x["norm"] * y["norm"])
    return (
        F.when(same, 1.0)
        .when((x["norm"] == 0) | (y["norm"] == 0), 0.0)
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))
    )


def fingerprint(docs: DataFrame) -> DataFrame:
    """docs with ``vector`` and ``fingerprint`` of each text."""
    return docs.withColumn("vector", vector(text_of())).withColumn("fingerprint", printed(F.col("vector")))


def predecessors(lengths: DataFrame) -> DataFrame:
    """key, before, wanted: the key before each key (before the first: the last) and that one's ``wanted``.

    lengths: (key, wanted), keys once each. Keys are sorted over the cluster; only the ends of the sorted
    parts, one row a part, meet in one place.
    """
    sorted_keys = lengths.repartitionByRange("key").select("key", "wanted", F.spark_partition_id().alias("part"))
    kept, _ = written(sorted_keys, "fingerprint-keys")
    ends = kept.groupBy("part").agg(F.max(F.struct("key", "wanted")).alias("end"))
    everywhere = Window.orderBy("part")
    ends = ends.select(
        "part",
        F.lag("end").over(everywhere).alias("previous"),
        F.last("end").over(everywhere.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("final"),
    ).select("part", F.coalesce("previous", "final").alias("end"))
    inside = F.lag(F.struct("key", "wanted")).over(Window.partitionBy("part").orderBy("key"))
    both = kept.withColumn("b", inside).join(ends, "part").withColumn("b", F.coalesce("b", "end"))
    return both.select("key", F.col("b.key").alias("before"), F.col("b.wanted").alias("wanted"))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, head, fingerprint, groups: the next document's first floor(n_chars / 2) code points, fingerprint and counters."""
    own = docs.select("doc_id", F.coalesce("doc_id", F.lit(-(2**63))).alias("key"), text_of().alias("text"))
    lengths = own.groupBy("key").agg(F.max(F.expr("length(text) div 2")).alias("wanted"))
    before = predecessors(lengths)
    heads = (
        own.join(before, "key")
        .select("doc_id", "text", "before", "wanted", vector(F.col("text")).alias("v"))
        .select(
            F.col("before").alias("key"),
            F.struct(
                F.xxhash64("text").alias("h"),
                F.substr("text", F.lit(1), F.col("wanted").cast("int")).alias("head"),
                printed(F.col("v")).alias("fingerprint"),
                "v.groups",
                "doc_id",  # so that both joins read one shuffle of the texts
            ).alias("following"),
        )
        .groupBy("key")
        .agg(F.min("following").alias("following"))
    )
    return own.join(heads, "key").select("doc_id", "text", "following.head", "following.fingerprint", "following.groups")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose second half the next document's start replaces."""
    half = F.expr("length(text) div 2")
    rows = with_next(docs).select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.concat(
            F.substr("text", F.lit(1), F.length("text") - half.cast("int")), F.substr("head", F.lit(1), half.cast("int"))
        ).alias("edited"),
        vector(F.col("text")).alias("v"),
        F.col("fingerprint").alias("next_fingerprint"),
        "groups",
    )
    own, edited = F.col("v"), F.col("e")
    seen = rows.withColumns({"e": vector(F.col("edited")), "edited_sha256": sha256_hex(F.col("edited"))}).drop("edited")
    shown = seen.select(
        "doc_id", "n_chars", "edited_sha256", printed(own).alias("fingerprint"), printed(edited).alias("edited_fingerprint"), "next_fingerprint",
        signs(own["groups"]).alias("s"), signs(edited["groups"]).alias("se"), signs(F.col("groups")).alias("sn"),
    )
    return shown.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("s"), F.col("se"), F.col("fingerprint") == F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("s"), F.col("sn"), F.col("fingerprint") == F.col("next_fingerprint")).alias("near_next"),
    )
