"""Conversation trie, hard negatives and embedding near-duplicates against brute force and against SQL on planted tables."""

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from sweepline.llm import embedding_dedup, hard_negatives, oracles, prefix_trie
from tests.llm.helpers import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def said(sql, **tables):
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t)
    return sorted(con.sql(sql).fetchall(), key=str)


# ---- trie ----------------------------------------------------------------------------------------------------


def trie_by_hand(turns):
    """turns: (conv_id, turn, role, text), each conversation's in order and without ties."""
    conv = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            conv[c].append((turn is not None, turn or 0, role or "", text or ""))
    whole = {c: [x[2:] for x in sorted(v)] for c, v in conv.items()}
    built = {}
    for c, own in whole.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = whole.get(c - c % 20, [])[:h] + own[h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * len(WORD.findall(k[-1][1])) if k else 0
            leaves[k[:d]] += not kids[k]
    digest = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return sorted(
        ((m[0], len(k), members[k[:-1]][0] if k else None, len(m), kids[k], leaves[k], saved[k], digest([c for c in m if len(built[c]) == len(k)])) for k, m in members.items()),
        key=str,
    )


def planted_turns(seed, n, length, words):
    random = np.random.default_rng(seed)
    turns = []
    for c in range(n):
        if c % 20 == 0 and c % 60:
            continue  # families without their first conversation
        for d in range(int(random.integers(1, length))):
            turns.append((c, d, ("user", "assistant", None)[d % 3], (None, "", "a b", "a b c", " x\ty ")[int(random.integers(0, words))]))
    turns += [(100_000 + k, d, "user", f"copy {d}") for k in range(9_000) for d in range(2)]  # ids in several pieces
    return turns


@pytest.mark.parametrize(("seed", "length", "words"), [(1, 6, 2), (2, 12, 3), (3, 4, 5)])
def test_trie_by_brute_force(spark, seed, length, words):
    turns = planted_turns(seed, 300, length, words)
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = prefix_trie.prefix_trie(df)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert rows_of(got) == trie_by_hand(turns)


@pytest.mark.parametrize("parts", [1, 3, 37])
def test_trie_is_the_same_for_any_partitions(spark, parts):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    turns = [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()] + [(k, d, "user", f"t{d}") for k in range(500, 640) for d in range(k % 9)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = rows_of(prefix_trie.prefix_trie(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == trie_by_hand(turns)


def test_trie_edges(spark):
    kind = "conv_id long, turn long, role string, text string, key string, depth int"
    assert rows_of(prefix_trie.prefix_trie(spark.createDataFrame([], kind))) == []
    turns = [(None, 0, "user", "lost"), (7, None, None, None), (7, 1, "user", "w " * 50_000), (7, 1, "user", "tie"), (7, 1, "user", "tie"), (41, 5, "user", "only")]
    got = prefix_trie.prefix_trie(spark.createDataFrame([(*t, "x", 1) for t in turns], kind))
    table = pa.table({n: [t[k] for t in turns] for k, n in enumerate(("conv_id", "turn", "role", "text"))}, schema=pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))
    assert rows_of(got) == said(oracles.trie(), conversations=table)
    root = got.where("depth = 0").first()
    assert (root.conv_id, root.parent_conv_id, root.n_convs) == (7, None, 2)


def test_common_turns():
    a = bytes(range(64))
    assert prefix_trie.common_turns(a, a) == 4
    assert prefix_trie.common_turns(a, a[:40] + b"x" * 24) == 2
    assert prefix_trie.common_turns(b"", a) == 0


# ---- hard negatives ------------------------------------------------------------------------------------------


def vector_table(rows, dtype=None):
    return pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(dtype or pa.float32())), "label": pa.array([r[2] for r in rows], pa.int32())})


def vector_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<float>, label int, no string, tile int")


def negatives_by_hand(rows):
    kept = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v], (y + 1) % 10 if i % 7 == 0 else y) for i, v, y in rows if v is not None and y is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v, y in (r for r in kept if r[0] % 100 == 0):
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, z) for j, w, z in kept if j != i)
        for s, j, _ in [x for x in scored if x[2] == y][:5]:
            fits = [x for x in scored if x[2] != y and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(i, j, n + 1, k, -s, -t) for n, (t, k, _) in enumerate(fits)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("scale", "rows", "anchors"), [(0.1, 64, 3), (2.0, 7, 1), (0.004, 500, 50)])
def test_negatives_by_brute_force(spark, scale, rows, anchors):
    random = np.random.default_rng(5)
    data = [(int(i), [float(x) for x in np.float32(random.normal(size=12) * scale)], int(random.integers(0, 10))) for i in range(600)]
    data += [(1000 + k, data[k % 5][1], k % 3) for k in range(60)]  # ties
    data += [(700, None, 1), (800, [1.0, None] * 6, 1), (900, [float("nan")] * 12, 2), (2000, [0.5] * 12, None), (2100, [float("inf")] * 12, 1)]
    p = hard_negatives.Parameters(rows=rows, anchors=anchors)
    got = hard_negatives.hard_negatives(vector_frame(spark, data), p)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert rows_of(got) == negatives_by_hand(data)
    assert rows_of(got) == said(oracles.negatives(), embeddings=vector_table(data))


def test_negatives_edges(spark):
    assert rows_of(hard_negatives.hard_negatives(vector_frame(spark, []))) == []
    alone = [(0, [1.0, 0.5], 1), (None, [1.0, 0.5], 1), (3, [], 1), (4, [1e9, 0.0], 1)]
    assert rows_of(hard_negatives.hard_negatives(vector_frame(spark, alone))) == []
    # rows of other lengths are never compared; repeated rows count one by one
    mixed = [(0, [1.0, 1.0], 1), (1, [1.0, 1.0], 2), (2, [1.0, 1.0, 9.0], 2), (3, [0.9, 1.0], 3), (3, [0.9, 1.0], 3)]
    got = rows_of(hard_negatives.hard_negatives(vector_frame(spark, mixed)))
    one, other = 256 * 256 * 2, 256 * 230 + 256 * 256
    assert got == [(0, 1, 1, 3, one, other), (0, 1, 2, 3, one, other)]


def test_planes_drop_rows_only_when_they_cannot_qualify():
    random = np.random.default_rng(9)
    anchors, rows = random.integers(-130, 130, (4, 16)), random.integers(-130, 130, (300, 16))
    exact, asked = anchors @ rows.T, []

    def drop(a, r, low, high):
        assert np.all(low <= exact[a, r]) and np.all(exact[a, r] <= high)
        asked.append((len(a), int((high - low).max(initial=0))))
        return high < np.sort(exact, axis=1)[a, -3]

    a, r, score = hard_negatives.score_intervals(anchors, rows, np.ones((4, 300), bool), drop)
    assert np.array_equal(score, exact[a, r])
    assert set(zip(a.tolist(), r.tolist(), strict=True)) == {(i, j) for i in range(4) for j in np.nonzero(exact[i] >= np.sort(exact[i])[-3])[0].tolist()}
    assert asked == sorted(asked, reverse=True) and asked[-1][1] == 0


# ---- embedding near-duplicates -------------------------------------------------------------------------------


def groups_by_hand(rows, cosine=0.93):
    ok = [v is not None and y is not None and i is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v, y in rows]
    n, links, low = len(rows), [0] * len(rows), list(range(len(rows)))
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if o else None for (_, v, _), o in zip(rows, ok, strict=True)]
    find = lambda k: k if low[k] == k else find(low[k])
    for a in range(n):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine:
                links[a] += 1
                links[b] += 1
                low[find(a)] = find(b)
    least = defaultdict(lambda: 1 << 60)
    for k in range(n):
        if rows[k][0] is not None:
            least[find(k)] = min(least[find(k)], rows[k][0])
    return sorted(((rows[k][0], links[k], c := None if rows[k][0] is None else least[find(k)], rows[k][0] == c) for k in range(n)), key=str)


def planted_vectors(seed, n, width, noise):
    random = np.random.default_rng(seed)
    centres = random.normal(size=(n // 12, width))
    data = [(int(k), [float(x) for x in np.float32(centres[k % len(centres)] * (1 + k % 3) + random.normal(size=width) * noise)], int(k % len(centres) % 3)) for k in range(n)]
    return [*data, *((5000 + k, data[k % 2][1], data[k % 2][2]) for k in range(40))]


@pytest.mark.parametrize(("width", "noise", "rows"), [(16, 0.25, 50), (64, 0.2, 2048), (3, 0.1, 20), (1, 0.5, 30)])
def test_embeddings_by_brute_force(spark, width, noise, rows):
    data = planted_vectors(width, 240, width, noise)
    p = embedding_dedup.Parameters(rows=rows, steps=(2, 8, 24))
    got = rows_of(embedding_dedup.near_duplicates(vector_frame(spark, data), p))
    want = groups_by_hand(data)
    assert got == want
    assert got == said(oracles.embedding_groups(), embeddings=vector_table(data))
    assert max(r[1] for r in want) >= 20 and sum(not r[3] for r in want) > 40


def test_embedding_edges(spark):
    assert rows_of(embedding_dedup.near_duplicates(vector_frame(spark, []))) == []
    unlinked = [(1, None, 1), (2, [], 1), (3, [0.0, -0.0], 1), (4, [1.0, None], 1), (5, [1.0, float("nan")], 1), (6, [float("inf"), 1.0], 1), (7, [1.0, 2.0], None), (None, [1.0, 2.0], 1)]
    assert rows_of(embedding_dedup.near_duplicates(vector_frame(spark, unlinked))) == sorted(((r[0], 0, r[0], True) for r in unlinked), key=str)
    linked = [*unlinked[:-1], (8, [1.0, 2.0], 1), (9, [2.0, 4.1], 1), (9, [2.0, 4.1], 1), (9, [-1.0, 2.0], 1), (10, [1.0, 2.0, 0.0], 1), (11, [1e-30, 2e-30], 1), (12, [1e30, 2e30], 1), (13, [1.0, 2.0], 2)]
    assert rows_of(embedding_dedup.near_duplicates(vector_frame(spark, linked))) == groups_by_hand(linked)


def test_bounds_lose_no_pair():
    random = np.random.default_rng(3)
    a = np.repeat(random.normal(size=(100, 32)), 7, axis=0) + random.normal(size=(700, 32)) * 0.45
    axes, _ = np.linalg.qr(random.normal(size=(32, 32)))
    p = embedding_dedup.Parameters(cosine=0.8)
    i, j = embedding_dedup.linked_pairs(a, a, axes, p, same=True)
    u = embedding_dedup.unit(a)
    x, y = np.nonzero(np.triu(u @ u.T >= 0.8, 1))
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(x.tolist(), y.tolist(), strict=True))
    assert len(i) > 100
