"""Byte-level BPE, fingerprints, media, licences and LM scores against brute force."""

import base64
import hashlib
import pathlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sweepline.llm import byte_bpe, fingerprint, licenses, lm_scoring, media, queries, webp
from sweepline.llm.license_texts import LICENSES
from tests.llm.helpers import SF, edge_docs, no_docs, sample_docs

VOCABULARY = byte_bpe.public_vocabulary()
CODER = byte_bpe.Coder.of(*VOCABULARY)


def plain_ids(text):
    return CODER.plain.encode_ordinary(text)


def test_tree_equals_one_pass_on_documents(spark):
    rows = sample_docs(spark).select("text").collect()
    for r in rows:
        for leaf in (7, 64, 1024):
            assert CODER.encode(r["text"], leaf).tolist() == plain_ids(r["text"])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB1' \n\t.,é  你\x1c\U0001f600", max_size=60), st.integers(1, 9))
def test_tree_equals_one_pass_on_any_text(text, leaf):
    ids = CODER.encode(text, leaf)
    assert ids.tolist() == plain_ids(text)
    assert CODER.decode(ids) == text.encode()


def test_bpe_query_and_edge_rows(spark):
    rows = queries.op8_byte_bpe(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in sample_docs(spark).collect()}
    assert len(rows) == len(texts)
    for r in rows:
        ids = np.array(plain_ids(texts[r["doc_id"]]), dtype="<u4")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    edge = byte_bpe.decode_documents(byte_bpe.encode_documents(edge_docs(spark), *VOCABULARY), *VOCABULARY, "tokens_")
    source = edge_docs(spark).select("doc_id", F.coalesce("text", F.lit("")).alias("t")).collect()
    assert sorted((r["doc_id"] or -1, bytes(r["decoded"])) for r in edge.collect()) == sorted(
        (r["doc_id"] or -1, r["t"].encode()) for r in source
    )
    assert byte_bpe.encode_documents(no_docs(spark), *VOCABULARY).count() == 0
    assert isinstance(CODER.plain, tiktoken.Encoding)


def test_bpe_encodes_texts_without_cuts_once(monkeypatch):
    done = []
    leaf = byte_bpe.Coder.leaf
    monkeypatch.setattr(byte_bpe.Coder, "leaf", lambda self, text: (done.append(len(text)), leaf(self, text))[1])
    for text in ("x" * 50_000, "你好" * 9_000, "ab1" * 9_000 + " c" + "d" * 9_000):
        done.clear()
        assert CODER.encode(text).tolist() == plain_ids(text)
        assert sum(done) <= 2 * len(text)


def test_bpe_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a text", "own", "own", 7), (2, None, None, "x", None)], "doc_id long, text string, tokens string, Decoded string, n_tokens int")
    encoded = byte_bpe.encode_documents(docs, *VOCABULARY)
    assert encoded.columns == ["doc_id", "tokens", "Decoded", "n_tokens", "tokens_"]
    decoded = byte_bpe.decode_documents(encoded, *VOCABULARY, "tokens_")
    rows = {r["doc_id"]: r for r in decoded.collect()}
    assert bytes(rows[1]["decoded_"]) == b"a text" and bytes(rows[2]["decoded_"]) == b""
    assert [tuple(rows[i])[1:4] for i in (1, 2)] == [("own", "own", 7), (None, "x", None)]


def edited_by_hand(rows):
    """(doc_id, text) in any order, ids once each -> doc_id: edited text."""
    rows = sorted(rows)
    out = {}
    for i, (doc_id, text) in enumerate(rows):
        half = len(text) // 2
        out[doc_id] = text[: len(text) - half] + rows[(i + 1) % len(rows)][1][:half]
    return out


def cosine_by_hand(x, y):
    """Of the counts of pieces (at most 12 characters of a word) with the piece before in the line."""
    counts = []
    for text in (x, y):
        found = Counter()
        for line in text.split("\n"):
            pieces = re.findall(r"[^ \t\n\x0b\f\r]{1,12}", line)
            found.update(zip(["", *pieces], pieces, strict=False))
        counts.append(found)
    a, b = counts
    if a == b:
        return 1.0
    norm = sum(v * v for v in a.values()) * sum(v * v for v in b.values())
    return sum(v * b[k] for k, v in a.items()) / norm**0.5 if norm else 0.0


def test_fingerprint_query(spark):
    docs = sample_docs(spark)
    rows = queries.op1_fingerprint(spark, SF).collect()
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    edited = edited_by_hand(texts)
    assert len(rows) == len(texts)
    for r in rows:
        assert r["edited_sha256"] == hashlib.sha256(edited[r["doc_id"]].encode()).hexdigest()
        assert r["n_chars"] == len(dict(texts)[r["doc_id"]])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    longer = [r for r in rows if r["n_chars"] > 60]
    assert all(r["near_edited"] > r["near_next"] for r in longer)
    order = sorted(dict(texts))
    by_id = dict(texts)
    for r in rows:  # estimates against exact cosines
        following = by_id[order[(order.index(r["doc_id"]) + 1) % len(order)]]
        assert abs(r["near_edited"] - cosine_by_hand(by_id[r["doc_id"]], edited[r["doc_id"]])) < 0.35
        assert abs(r["near_next"] - cosine_by_hand(by_id[r["doc_id"]], following)) < 0.35
    off = [r["near_edited"] - cosine_by_hand(by_id[r["doc_id"]], edited[r["doc_id"]]) for r in longer]
    assert np.std(off) < 0.09
    by_text = {}
    for r in rows:
        by_text.setdefault(dict(texts)[r["doc_id"]], set()).add(r["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())
    assert len({next(iter(x)) for x in by_text.values()}) == len(by_text)


def test_fingerprint_is_homomorphic(spark):
    df = spark.createDataFrame(
        [("one\ntwo. three\nfour", "two. three\none\n\nfour", "one\nfour", "two. three")], "x string, y string, z string, w string"
    )
    v = fingerprint.vector
    row = df.select(
        fingerprint.printed(v(F.col("x"))).alias("x"),
        fingerprint.printed(v(F.col("y"))).alias("y"),
        fingerprint.printed(fingerprint.combined(v(F.col("z")), v(F.col("w")))).alias("sum"),
        fingerprint.printed(fingerprint.combined(v(F.col("x")), v(F.col("w")), -1)).alias("difference"),
        fingerprint.printed(v(F.col("z"))).alias("z"),
    ).first()
    assert row["x"] == row["y"] == row["sum"] and row["difference"] == row["z"] != row["x"]
    exact = [0] * 128
    for line in ("one", "two. three", "four"):
        d = b"".join(hashlib.sha512(f"{i}:{line}".encode()).digest() for i in range(8))
        exact = [(a + zlib.crc32(d[4 * i : 4 * i + 4])) % 2**32 for i, a in enumerate(exact)]
    assert row["x"].startswith(hashlib.sha256(",".join(map(str, exact)).encode()).hexdigest() + "-4-")


def test_fingerprint_ignores_the_order_of_paragraphs(spark):
    pairs = [("one.\n\ttwo", "\ttwo\none."), ("a b\r\n\x0b\n c d.", " c d.\na b\r"), ("x! y\nz w? v", "z w? v\n\t \nx! y")]
    df = spark.createDataFrame(pairs, "x string, y string")
    shown = df.select(*[fingerprint.printed(fingerprint.vector(F.col(c))).alias(c) for c in "xy"]).collect()
    assert all(r["x"] == r["y"] for r in shown) and len({r["x"] for r in shown}) == 3


def test_fingerprint_likeness_of_texts_without_sentences(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 9999, 40)), "".join(chr(c) for c in rng.integers(0x4E00, 0x9000, 400)), "".join(chr(c) for c in rng.integers(97, 123, 700))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in fingerprint.edited_fingerprints(docs).collect():
        assert r["near_edited"] > max(0.25, r["near_next"] + 0.15)


def test_fingerprint_edge_rows(spark):
    assert fingerprint.edited_fingerprints(no_docs(spark)).count() == 0
    rows = fingerprint.edited_fingerprints(edge_docs(spark)).collect()
    assert len(rows) == edge_docs(spark).count()
    zero = [r for r in rows if r["n_chars"] == 0]
    assert len(zero) == 2 and all(r["edited_sha256"] == hashlib.sha256(b"").hexdigest() for r in zero)
    one = fingerprint.edited_fingerprints(sample_docs(spark).limit(1)).first()
    assert one["near_next"] == 1.0


def test_media_query_and_edge_rows(spark):
    texts = {r["doc_id"]: r["text"] for r in sample_docs(spark).collect()}
    rows = queries.op2_media(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        data = texts[r["doc_id"]].encode()
        payload = data.ljust(max(64, 64 * ((len(data) + 63) // 64)), b"\0")
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
    edge = media.decode_media(media.store_payloads(edge_docs(spark)))
    assert edge.where("error is not null").count() == 0 and edge.count() == edge_docs(spark).count()
    assert media.store_payloads(no_docs(spark)).count() == 0
    broken = spark.createDataFrame([([b"no image"],), (None,)], "media array<binary>")
    assert [r["payload"] for r in media.decode_media(broken).collect()][0] is None
    assert media.pixels(media.store_payloads(edge_docs(spark))).where("width <> 64").count() == 0


def test_media_payload_lengths(spark):
    """Bytes 0 up to a positive multiple of 64: written-out lengths, hashes by hand."""
    sizes = {0: 64, 1: 64, 63: 64, 64: 64, 65: 128, 127: 128, 128: 128, 129: 192}
    docs = spark.createDataFrame([(n, "x" * n) for n in sizes], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in media.digests(media.decode_media(media.store_payloads(docs))).collect()}
    for n, size in sizes.items():
        payload = b"x" * n + b"\0" * (size - n)
        assert (rows[n]["n_bytes"], rows[n]["payload_bytes"]) == (n, size)
        assert rows[n]["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert rows[n]["tail_crc32"] == zlib.crc32(payload[-64:])


def file_of(*fields):
    """A WebP file of (value, bits) fields, lowest bit first, built without the module under test."""
    text = "".join(format(v, f"0{n}b")[::-1] for v, n in fields)
    text += "0" * (-len(text) % 8)
    body = b"\x2f" + bytes(int(text[i : i + 8][::-1], 2) for i in range(0, len(text), 8))
    chunk = b"VP8L" + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) % 2)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


def size_of(width, height):
    return [(width - 1, 14), (height - 1, 14), (1, 1), (0, 3)]


def lone(symbol):
    """A code of one symbol of 8 bits."""
    return [(1, 1), (0, 1), (1, 1), (symbol, 8)]


def test_webp_reads_foreign_files():
    # files of other writers
    transparent = base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")
    white = base64.b64decode("UklGRh4AAABXRUJQVlA4TBEAAAAvAAAAAAfQ//73v/+BiOh/AAA=")
    assert webp.decode(transparent).tolist() == [[0]] and webp.decode(white).tolist() == [[0xFFFFFFFF]]


def test_webp_reads_bit_strings_by_hand():
    # predictor 1 (left) over one block; greens of two symbols, 3 and 7, as 3 7 / 7 3
    predictor = file_of(
        *size_of(2, 2), (1, 1), (0, 2), (0, 3), (0, 1), *lone(1), *lone(0) * 4,
        (0, 1), (0, 1), (0, 1), (1, 1), (1, 1), (1, 1), (3, 8), (7, 8), *lone(0) * 4, (0, 1), (1, 1), (1, 1), (0, 1),
    )
    assert webp.decode(predictor).tolist() == [[0xFF000300, 0xFF000A00], [0xFF000A00, 0xFF000D00]]
    # green to red 64 / 32, green to blue 32 / 32, red to blue 16 / 32
    cross = file_of(
        *size_of(1, 1), (1, 1), (1, 2), (0, 3), (0, 1), *lone(32), *lone(16), *lone(64), *lone(255), *lone(0),
        (0, 1), (0, 1), (0, 1), *lone(10), *lone(4), *lone(1), *lone(255), *lone(0),
    )
    assert webp.decode(cross).tolist() == [[0xFF180A17]]
    # a cache of two colours: one literal of green 11, then its cache place twice; lengths are 11 zeros, 1, 268 or 269 zeros, 1
    place = (0x1E35A7BD * 0xFF000B00 & 0xFFFFFFFF) >> 31
    lengths = [(0, 1), (0, 4), (0, 3), (1, 3), (0, 3), (1, 3), (0, 1), (1, 1), (0, 7), (0, 1), (1, 1), (127, 7), (1, 1), (119 + place, 7), (0, 1)]
    if not place:  # the other place has no code
        lengths[6:7] = [(1, 1), (1, 3), (3, 4)]  # so five lengths and runs are read
    cached = file_of(
        *size_of(3, 1), (0, 1), (1, 1), (1, 4), (0, 1), *lengths, *lone(0), *lone(0), *lone(255), *lone(0), (0, 1), (1, 1), (1, 1)
    )
    assert webp.decode(cached).tolist() == [[0xFF000B00] * 3]
    # a copy of three pixels (symbol 258) from one back (plane code 2): lengths are 11 zeros, 1, 246 zeros, 1
    lengths = [(0, 1), (0, 4), (0, 3), (1, 3), (0, 3), (1, 3), (1, 1), (1, 3), (3, 4), (1, 1), (0, 7), (0, 1), (1, 1), (127, 7), (1, 1), (97, 7), (0, 1)]
    copied = file_of(
        *size_of(4, 1), (0, 1), (0, 1), (0, 1), *lengths, *lone(0), *lone(0), *lone(255), *lone(1), (0, 1), (1, 1)
    )
    assert webp.decode(copied).tolist() == [[0xFF000B00] * 4]


def test_webp_transforms_cache_and_codes():
    rng = np.random.default_rng(5)
    image = webp.joined((rng.integers(0, 6, (13, 21, 4)) * 40).astype(np.int32))
    green = (image & np.uint32(0xFF00)) | np.uint32(0xFF000000)
    blocks = lambda h, w, high: rng.integers(0, high, (h, w), dtype=np.uint32)
    predictor = (webp.PREDICTOR, 2, blocks(4, 6, 14) << np.uint32(8))
    cross = (webp.CROSS_COLOUR, 3, blocks(2, 3, 2**32))
    for cache in (0, 1, 5, 11):
        for transforms in ((), ((webp.SUBTRACT_GREEN,),), (predictor,), (cross,), (predictor, cross, (webp.SUBTRACT_GREEN,))):
            assert (webp.decode(webp.encode(image, transforms, cache)) == image).all()
        assert (webp.decode(webp.encode(green, ((webp.PALETTE,),), cache)) == green).all()


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=3000), st.integers(1, 40))
def test_webp_bytes_round_trip(data, times):
    data = (data + b"\n") * times
    data += bytes(64 - len(data) % 64)
    file = webp.encode_bytes(data)
    assert ((webp.decode(file) >> np.uint32(8)) & np.uint32(255)).astype(np.uint8).tobytes() == data


def test_webp_copies_overlap_and_cross_blocks():
    data = b"".join(b"line %d of a text that goes on\n" % (i % 700) for i in range(4000)) + b"z\n" * 9000
    data += bytes(64 - len(data) % 64)
    file = webp.encode_bytes(data)
    assert len(file) < len(data) / 3
    assert ((webp.decode(file) >> np.uint32(8)) & np.uint32(255)).astype(np.uint8).tobytes() == data


def test_licenses(spark):
    mit = LICENSES["MIT"]
    changed = "Copyright (c) 2020 Someone\n\n" + mit.upper().replace("SUBLICENSE", "sub-licence").replace(",", " ,")
    rows = [
        (1, changed), (2, "before\n\n" + mit.replace("\n\n", "\n") + "\n\nafter"), (3, None), (4, ""), (6, "nothing"),
        (5, "text\n# Released under the MIT Licence\n"), (7, "SPDX-License-Identifier: Apache-2.0\nthis work is licensed under CC BY-NC 4.0."),
        (8, "released under the moon\n\nMIT"), (1, changed), (None, changed),
        (9, "Distributed under the terms of the GNU General Public License, version 3.0" + "\n\nmore" * 30_000),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("clash")).withColumn("k", F.lit(1))
    rows = licenses.scan(docs).collect()
    found = {r["doc_id"]: (r["license"], r["parts"], r["notices"]) for r in rows}
    assert found[1] == found[None] == ("MIT", ["MIT"], []) and found[2] == (None, ["MIT"], []) and found[5] == (None, [], ["MIT"])
    assert found[3] == found[4] == found[6] == found[8] == (None, [], [])
    assert found[7] == (None, [], ["Apache-2.0", "CC-BY-NC-4.0"]) and found[9] == (None, [], ["GPL-3.0-only"])
    assert len(rows) == docs.count()
    assert licenses.scan(no_docs(spark)).count() == 0
    assert queries.op10_licenses(spark, SF).count() == sample_docs(spark).count()


def canonical_by_hand(text):
    """The canonical form, by other means."""
    lines = [x for x in text.lower().split("\n") if not re.match(r"[^a-z0-9\n]*(copyright ?(\(c\)|©|[0-9])|\(c\) ?[0-9]|©|all rights reserved)", x)]
    form = "\n".join(lines)
    for pattern, one in licenses.SPELLINGS:
        form = re.sub(pattern, one, form)
    return " ".join("".join(c if c.isalpha() or c.isdigit() else " " for c in form).split())


PUBLISHED = pathlib.Path("/usr/share/common-licenses")


@pytest.mark.skipif(not PUBLISHED.exists(), reason="no published licence texts here")
def test_published_licenses_in_full(spark):
    files = {"Apache-2.0": "Apache-2.0", "GPL-2.0-only": "GPL-2", "GPL-3.0-only": "GPL-3", "LGPL-2.1-only": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    texts = {k: (PUBLISHED / f).read_text("utf-8") for k, f in files.items()}
    rows = []
    for i, (k, t) in enumerate(texts.items()):
        rows += [(k, 3 * i, t), (k, 3 * i + 1, "Copyright (c) 1999 A\n" + " ".join(t.upper().split(" "))), (k, 3 * i + 2, f"mine\n\n{t}\n\nthe rest")]
    found = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "name string, doc_id long, text string")).collect()}
    for k, i, t in rows:
        assert found[i]["digest"] == hashlib.sha256(canonical_by_hand(t).encode()).hexdigest()
        assert found[i]["license"] == (None if i % 3 == 2 else k) and k in found[i]["parts"]
    cut = texts["GPL-3.0-only"].replace("freedom", "liberty", 1)
    assert licenses.scan(spark.createDataFrame([(1, cut)], "doc_id long, text string")).first()["license"] is None


def test_lm_scores(spark):
    p = lm_scoring.Parameters(words=20, endings=10, hidden=8)
    model = lm_scoring.fit(sample_docs(spark), p)
    rows = {r["doc_id"]: r for r in lm_scoring.score_documents(sample_docs(spark), model).collect()}
    net = lm_scoring.Network(model.flat, p)
    for r in sample_docs(spark).limit(20).collect():
        c = lm_scoring.classes_of(r["text"], model.words, model.endings, p.ending_letters)
        total = 0.0
        for left, token, right in zip(c, c[1:], c[2:], strict=False):
            z = np.tanh(net.left[left] + net.right[right]) @ net.out.T.astype(float) + net.bias
            total += z[token] - np.log(np.exp(z).sum())
        assert abs(total - rows[r["doc_id"]]["log_likelihood"]) < 1e-2 * max(1, len(c) / 100)
        assert rows[r["doc_id"]]["n_tokens"] == len(c) - 2
    means = [r["mean_log_likelihood"] for r in rows.values() if r["n_tokens"] > 50]
    assert np.mean(means) > -np.log(p.classes) + 0.3  # better than chance
    edge = lm_scoring.score_corpus(edge_docs(spark), p).collect()
    assert len(edge) == edge_docs(spark).count()
    assert all(r["log_likelihood"] == 0 and r["mean_log_likelihood"] is None for r in edge if r["n_tokens"] == 0)
    assert lm_scoring.score_corpus(no_docs(spark), p).count() == 0
    counts = lm_scoring.triple_counts(sample_docs(spark), model.words, model.endings, p)
    assert counts.agg(F.sum("n")).first()[0] == sum(r["n_tokens"] for r in rows.values())


def test_lm_scores_words_inside_their_classes(spark):
    p = lm_scoring.Parameters(words=2, endings=2, hidden=4)
    real = "the cat and the hat and the bat " * 20
    junk = "the xqcat and the zzhat and the qqbat"  # words of the same endings
    rows = [(1, real), (2, "the cat and the hat and the bat"), (3, junk), (3, junk), (None, None), (4, "the and")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = lm_scoring.fit(docs, p)
    classes = {(r["doc_id"], r["n_tokens"]): r["log_likelihood"] for r in lm_scoring.score_documents(docs, model).collect()}
    assert abs(classes[2, 8] - classes[3, 8]) < 1e-4  # the classes can't tell them apart
    counts = {}
    for _, text in rows:
        for word in lm_scoring.TOKEN.findall(text or ""):
            counts[word] = counts.get(word, 0) + 1
    members = {}
    for word in counts:
        if word not in model.words:
            members.setdefault(model.endings.get(word[-2:], lm_scoring.OTHER), []).append(word)
    inside = {
        w: np.log((counts[w] + p.unseen) / (sum(counts[x] for x in group) + p.unseen * (len(group) + 1)))
        for group in members.values()
        for w in group
    }
    found = lm_scoring.score_corpus(docs, p).collect()
    assert len(found) == len(rows)
    for r in found:
        text = next(t for i, t in rows if i == r["doc_id"]) or ""
        tokens = lm_scoring.TOKEN.findall(text)
        total = classes[r["doc_id"], len(tokens)] + sum(inside.get(w, 0.0) for w in tokens)
        assert abs(total - r["log_likelihood"]) < 1e-3 * max(1, len(tokens))
        assert r["mean_log_likelihood"] is None if not tokens else abs(r["mean_log_likelihood"] - total / len(tokens)) < 1e-3
    score = {r["doc_id"]: r["log_likelihood"] for r in found}
    assert score[2] > score[3] + 1


def test_licenses_in_their_own_layout_inside_a_text(spark):
    full = sorted(LICENSES)
    rows = [(i, f"before\n\nmore\n\nCopyright (c) 2020 Someone\n\n{LICENSES[k]}\n\nafter\n\nthe end") for i, k in enumerate(full)]
    assert all("\n\n" in LICENSES[k] for k in full)
    rows += [(90, "a\n\nb\n\nc"), (91, LICENSES["MIT"].split("\n\n")[0])]
    found = {r["doc_id"]: (r["license"], r["parts"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[i] == (None, [k]) for i, k in enumerate(full))
    assert found[90] == found[91] == (None, [])


def test_pixels_of_all_files(spark):
    text = "0123456789abcde\n" * ((media.FILE_BYTES + 640) // 16)
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    rows = sorted(media.pixels(media.store_payloads(docs)).collect(), key=lambda r: (r["doc_id"], r["file"]))
    assert [(r["doc_id"], r["file"], r["width"]) for r in rows] == [(1, 0, 64), (1, 1, 64), (2, 0, 64)]
    green = b"".join(((np.array(r["argb"]) >> 8) & 255).astype(np.uint8).tobytes() for r in rows[:2])
    assert green[: len(text)] == text.encode() and not any(green[len(text) :])
    none = media.pixels(spark.createDataFrame([(None,)], "media array<binary>")).first()
    assert (none["file"], none["width"], none["height"], none["argb"]) == (None, 0, 0, [])
