"""Near-dedup, mixing, toxicity, chat format, URL filters and the pipeline against brute force."""

import hashlib
import math
import re
import urllib.parse
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sweepline.llm import chat_format, components, mixing, near_dedup, queries, toxicity, url_filter
from tests.llm.helpers import SF, edge_docs, no_docs, sample_docs

P = near_dedup.Parameters()


def word_shingles(text, n=5):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def components_by_hand(texts, percent):
    """doc_id: (set size, smallest linked doc_id)."""
    sets = {i: word_shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_near_dedup_query(spark):
    texts = {r["doc_id"]: r["text"] for r in sample_docs(spark).collect()}
    expected = components_by_hand(texts, P.percent)
    rows = queries.op5_near_dedup(spark, SF).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == expected
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_near_dedup_finds_planted_pairs(spark):
    rng = np.random.default_rng(3)
    texts, n = {}, 0
    for size in (12, 40, 150, 600):
        for _ in range(6):
            words = [f"w{x}" for x in rng.integers(0, 10**6, size)]
            for share in (0, 0.004, 0.01, 0.015, 0.02, 0.03, 0.06):
                copy = [f"v{rng.integers(10**6)}" if rng.random() < share else w for w in words]
                texts[n] = " ".join(copy)
                n += 1
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = near_dedup.near_duplicates(docs).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == components_by_hand(texts, P.percent)


def test_near_dedup_edge_rows(spark):
    rows = near_dedup.near_duplicates(edge_docs(spark)).collect()
    assert len(rows) == edge_docs(spark).count()
    found = defaultdict(set)
    for r in rows:
        found[r["doc_id"]].add((r["n_shingles"], r["component_id"], r["kept"]))
    assert found[0] == {(0, 0, True)} and found[1] == {(0, 1, True)} and found[2] == {(0, 2, True)}
    assert found[5] == {(12, 5, True)} and found[6] == {(12, 5, False)} and found[7] == {(12, 5, False)}
    assert found[4] == {(1, 4, True), (2, 4, True)} and {x[1] for x in found[None]} == {None}
    assert near_dedup.near_duplicates(no_docs(spark)).count() == 0


def test_near_dedup_links_every_text_of_a_repeated_doc_id(spark):
    rng = np.random.default_rng(6)
    one, two, three = ([f"{c}{x}" for x in rng.integers(0, 10**6, 101)] for c in "abc")
    near = [*two[:50], "other", *two[51:]]
    rows = [(1, " ".join(one)), (1, " ".join(two)), (2, " ".join(near)), (3, " ".join(three)), (0, " ".join([*one[:-1], "end"])), (1, None)]
    found = defaultdict(set)
    for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found[r["doc_id"]].add((r["n_shingles"], r["component_id"]))
    assert found[2] == {(97, 0)} and found[0] == {(97, 0)} and found[3] == {(97, 3)}
    assert found[1] == {(97, 0), (0, 1)}


@pytest.mark.parametrize("percent", [80, 85, 90])
def test_distances_follow_from_the_threshold(percent):
    p = near_dedup.Parameters(percent=percent)
    tail = lambda n, c, d: 1 - sum(math.comb(n, i) * c**i * (1 - c) ** (n - i) for i in range(d + 1))
    assert tail(96, 1 - percent / 100, p.distance) <= 1e-5 < tail(96, 1 - percent / 100, p.distance - 1)
    assert tail(1024, (1 - percent / 100) / 2, p.unequal_bits) <= 1e-5 and p.errors == 1


def test_keys_meet_within_the_distance(spark):
    """Pigeonhole: any two signatures within the distance share a key."""
    rng = np.random.default_rng(1)
    rows, base = [], rng.integers(0, 2**16, P.minima).astype(np.uint16)
    for node in range(40):
        other = base.copy()
        at = rng.choice(P.minima, P.distance, replace=False)
        other[at] += 1
        rows.append((node, bytearray(other.tobytes())))
    rows.append((99, bytearray(base.tobytes())))
    keys = near_dedup.bucket_keys(spark.createDataFrame(rows, "node long, signature binary"), P)
    mine = keys.where("node = 99").select("key")
    assert keys.where("node <> 99").join(mine, "key").select("node").distinct().count() == 40


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [tuple(map(int, e)) for e in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(5001, 5200)]
    root = {}

    def top(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    df = spark.createDataFrame([*edges, (7, None)], "a long, b long")
    found = {r["node"]: r["component"] for r in components.connected_components(df).collect()}
    assert found == {i: top(i) for a, b in edges for i in (a, b) if a != b}


@pytest.mark.parametrize("shares", [{}, {"src0": 6, "src1": 3, "src2": 2}, {"src3": 5}])
def test_mix_keeps_every_row_within_a_block(spark, shares):
    p = mixing.Parameters(block=1, shares=shares)
    docs = sample_docs(spark)
    rows = sorted(mixing.mix(docs, p).collect(), key=lambda r: (r["slot"], r["place"]))
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs.collect())
    assert [r["slot"] for r in rows] == list(range(len(rows)))
    # while all sources last, each is less than one block from its target
    total = {r["source"]: r["count"] for r in docs.groupBy("source").count().collect()}
    share = {s: shares.get(s, 1) for s in total}
    frames = min(total[s] // share[s] for s in total)
    done, all_shares = defaultdict(int), sum(share.values())
    for n, r in enumerate(rows[: frames * all_shares], 1):
        done[r["source"]] += 1
        assert all(abs(done[s] - n * share[s] / all_shares) < 1 for s in total)


def test_mix_query(spark):
    """The registered query: whole blocks, in every frame less than a block from the target, all rows once."""
    p = mixing.Parameters()
    rows = queries.op6_mix(spark, SF).collect()
    docs = sample_docs(spark)
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    blocks = defaultdict(list)
    for r in rows:
        blocks[r["slot"]].append(r)
    assert sorted(blocks) == list(range(len(blocks)))
    left = {r["source"] or mixing.NULL_SOURCE: -(-r["count"] // p.block) for r in docs.groupBy("source").count().collect()}
    share = {s: p.shares.get(s, p.default_share) for s in left}
    slot, seen = 0, defaultdict(int)
    while any(left.values()):  # frame by frame, by hand
        due = {s: min(share[s], n) for s, n in left.items() if n}
        size, done = sum(due.values()), defaultdict(int)
        for n in range(1, size + 1):
            (source,) = {r["source"] for r in blocks[slot]}
            assert {r["block"] for r in blocks[slot]} == {seen[source]}
            assert sorted(r["place"] for r in blocks[slot]) == list(range(len(blocks[slot])))
            done[source] += 1
            seen[source] += 1
            slot += 1
            assert all(abs(done[s] - n * k / size) < 1 for s, k in due.items())
        for s, k in due.items():
            assert done[s] == k
            left[s] -= k
    assert slot == len(blocks)


def test_mix_hot_keys_and_shares(spark):
    rows = [(None, "a")] * 400 + [(7, "a")] * 400 + [(i, "a") for i in range(400)] + [(i, "b") for i in range(50)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), mixing.Parameters(block=4)).collect()
    assert len({(r["slot"], r["place"]) for r in found}) == len(rows)
    assert sorted(((r["doc_id"] or -1), r["source"]) for r in found) == sorted((i or -1, s) for i, s in rows)
    for wrong in ({"default_share": 0}, {"shares": {"a": 0}}, {"shares": {"a": 1.5}}, {"block": 0}):
        with pytest.raises(ValueError):
            mixing.Parameters(**wrong)


def test_mix_edge_rows(spark):
    rows = mixing.mix(edge_docs(spark), mixing.Parameters(block=2)).collect()
    assert len(rows) == edge_docs(spark).count()
    assert {r["source"] for r in rows} == {mixing.NULL_SOURCE, "src0", "src1"}
    assert len({(r["slot"], r["place"]) for r in rows}) == len(rows)
    assert mixing.mix(no_docs(spark)).count() == 0


def test_toxicity_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op7_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (toxicity.crc_fold(r["doc_id"]) == 0) for r in rows)
    yes = np.array([r["score"] for r in held if r["toxic"] == 1])
    no = np.array([r["score"] for r in held if r["toxic"] == 0])
    assert (yes[:, None] > no[None, :]).mean() > 0.9
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_toxicity_edge_rows(spark):
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(11)] + [(3, 0, 1), (None, 0, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(edge_docs(spark), labels).collect()
    assert len(rows) == edge_docs(spark).count() and all(0 <= r["score"] <= 1 for r in rows)
    none = toxicity.toxicity(edge_docs(spark), labels.where("false")).collect()
    assert {r["score"] for r in none} == {0.0}
    assert toxicity.toxicity(no_docs(spark), labels).count() == 0


def test_chat_query(spark):
    rows = {r["conv_id"]: r for r in queries.op4_chat_format(spark, SF).collect()}
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        turns[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    turns[-7] = [(0, "user", queries.EXTRA_TEXT), (1, "assistant", queries.EXTRA_TEXT)]
    assert set(rows) == set(turns)
    for k, t in turns.items():
        whole = "".join(f"{role}\n{text}\n" for _, role, text in sorted(t))
        loss = "".join(text for _, role, text in sorted(t) if role == "assistant")
        r = rows[k]
        assert (r["n_turns"], r["loss_chars"]) == (len(t), len(loss))
        assert r["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_escapes_and_edge_rows(spark):
    texts = ["</turn>\n### User: hi", "\\", "###", "#", "<", "</", "a\\</turn", None, "", "\n", ": ", "你" * 5000]
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(texts)]
    rows += [(2, 0, "to: ol", "x"), (2, 0, None, "y"), (None, None, "user", "z"), (3, 0, "assistant", "no"), (4, 0, "user", "q"), (4, 0, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("valid", F.lit(1))
    found = {r["conv_id"]: r for r in chat_format.digests(chat_format.format_conversations(df)).collect()}
    whole = "".join(f"{role}\n{text or ''}\n" for _, _, role, text in rows[: len(texts)])
    assert found[1]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest() and found[1]["valid"]
    assert found[2]["turns_sha256"] == hashlib.sha256(b"\ny\nto: ol\nx\n").hexdigest()
    assert found[4]["n_turns"] == 2 and not found[4]["valid"] and not found[3]["valid"] and found[None]["n_turns"] == 1
    assert chat_format.format_conversations(df.where("false")).count() == 0


def test_chat_templates_are_declarative(spark):
    roles = {"user": "U$er", "assistant": "Bot"}
    template = chat_format.Template(open="[[", close="]:", end="$>\n", loss_roles=("user", "tool"), shown=roles, moves={("begin", "user"): "answered"})
    texts = ["[[Bot]:", "$>", "$>\n[[U$er]:x", "]:", "\\$", "$", "[", "[[[", "$$>>", "", "### User: a</turn>\n"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate((r, t) for r in ("user", "User", "U$er", "Bot", "", "]:", "a]", "[[", "$>\n", "\\x", "tool") for t in texts)]
    rows += [(2, 0, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat_format.format_conversations(df, template)
    found = {r["conv_id"]: r for r in chat_format.digests(made, template).collect()}
    whole = "".join(f"{role}\n{text}\n" for _, _, role, text in rows[:-1])
    loss = "".join(text for _, _, role, text in rows[:-1] if role in ("user", "tool"))
    assert found[1]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest() and found[1]["n_turns"] == len(rows) - 1
    assert found[1]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and not found[1]["valid"] and found[2]["valid"]
    # with the production template a role of another's shown name stays itself
    named = spark.createDataFrame([(1, 0, "User", "a"), (1, 1, "user", "b"), (1, 2, "### User: ", "c")], df.schema)
    turns = chat_format.format_conversations(named).select(chat_format.read_back(F.col("formatted"), chat_format.Template()).alias("t")).first()["t"]
    assert [tuple(t) for t in turns] == [("User", "a"), ("user", "b"), ("### User: ", "c")]


@pytest.mark.parametrize("marks", [{"end": "aba"}, {"open": "x"}, {"close": ":\\"}, {"end": " </turn>"}, {"shown": {"a": "X", "b": "X"}}, {"shown": {"a": ": "}}, {"close": "n>\n"}])
def test_chat_templates_that_cannot_be_read_are_refused(marks):
    with pytest.raises(ValueError):
        chat_format.Template(**marks)


def judged_by_hand(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups()
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


def test_url_query(spark):
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op9_url_filter(spark, SF).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path, rule, verdict = judged_by_hand(urls[r["page_id"]], url_filter.RULES)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or "allow")


def test_url_aliases(spark):
    link = '<link href="{}" rel="canonical">'
    pages = [
        (1, "http://a.org/x", link.format("http://b.org/x")),
        (2, "http://b.org/x", '<meta http-equiv="refresh" content="0; url=http://Spam.example.com/en/1">'),
        (3, "HTTP://Spam.example.com/en/1", ""),
        (4, "http://c.org/", link.format("/y")),
        (5, "http://c.org/y", link.format("http://www.example.com/en/2")),
        (6, "http://c.org/y?z", link.format("http://x.net/es/q")),
        (7, None, None),
        (8, "no scheme", ""),
        (9, "http://net/es/", ""),
        (9, "http://net/es/", ""),
        (10, "http://x.net", link.format("http://x.net/es/q")),
        (11, "HTTP://R.org/a/b?c", "<link rel='stylesheet canonical' href=d>" + link.format("../e")),
        (12, "http://r.ORG/a/d#f", link.format("http://q.net/fr/")),
        (13, "http://r.org/e", ""),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("rule", F.lit("clash"))
    extra = spark.createDataFrame([("http://c.org/y", "http://x.net/es/z")], "url string, target string")
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(df, edges=extra).collect()}
    assert found[3] == ("example.com/en/", "block")
    assert found[1] == found[2] == (None, "block")  # their alias fits the rule, too
    assert found[4] == found[5] == (None, "allow")  # an allowed member outweighs a blocked one
    assert found[6] == found[10] == (None, "block") and found[9] == ("net/es/", "block")
    assert found[7] == found[8] == (None, "allow")
    assert found[11] == found[12] == found[13] == (None, "block")  # relative links, several tags, other spellings
    assert url_filter.filter_urls(df.where("false")).count() == 0


def spelled_by_hand(url):
    if not url or not re.match(r"[^:/?#]+://", url):
        return None
    scheme, rest = url.split("://", 1)
    host, path, query = re.match(r"([^/?#]*)([^?#]*)(\?[^#]*)?", rest, re.S).groups()
    return f"{scheme.lower()}://{host.lower()}{path or '/'}{query or ''}"


def test_url_aliases_against_brute_force(spark):
    rng = np.random.default_rng(8)
    hosts = [*(f"{s}{i}.org" for s in "sS" for i in range(30)), "www.example.com", *["x.Example.com", "c.net", "shop.net"] * 4]
    paths = ["", "/", "/en/", "/en/a/b", "/es/1", "/fr/", "/x/../y", "/q?z=1", "/q?z=2#f"]
    links = ["b", "../c", "./", "?z=1", "#top", "//s1.org/en/", "/es/1", "HTTP://C.net/es/", "mailto:me@x.net", "http://shop.NET/fr/"]
    pick = lambda some: str(some[rng.integers(len(some))])
    pages = []
    for i in range(120):
        url = f"http://{pick(hosts)}{pick(paths)}"
        made = [pick(links) if rng.random() < 0.5 else f"http://{pick(hosts)}{pick(paths)}" for _ in range(int(rng.integers(0, 2)))]
        tags = [f'<link rel="canonical" href="{t}">' if rng.random() < 0.6 else f"<META content='0; URL={t}' HTTP-EQUIV=refresh>" for t in made]
        pages.append((i, url, "<link rel='icon' href='/en/i.png'>" + "".join(tags), made))
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for _, url, _, made in pages:
        for t in made:
            a, b = spelled_by_hand(url), spelled_by_hand(urllib.parse.urljoin(url, t))
            if b:
                root[max(top(a), top(b))] = min(top(a), top(b))
    verdicts = defaultdict(set)
    for node in list(root):
        verdicts[top(node)].add(judged_by_hand(node, url_filter.RULES)[3])
    df = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")
    found = {r["page_id"]: r for r in url_filter.filter_urls(df).collect()}
    acted = 0
    for i, url, _, _ in pages:
        host, path, rule, verdict = judged_by_hand(url, url_filter.RULES)
        spread = verdicts[top(spelled_by_hand(url))] if spelled_by_hand(url) in root else set()
        expected = verdict or ("allow" if "allow" in spread else "block" if "block" in spread else "allow")
        assert (found[i]["host"], found[i]["path"], found[i]["rule"], found[i]["verdict"]) == (host, path, rule, expected)
        acted += verdict is None and expected == "block"
    assert acted > 3


def test_pipeline_stages(spark):
    docs = sample_docs(spark)
    wide = docs.withColumns({"slot": F.lit(1), "score": F.lit(2), "kept": F.lit(3)}).unionByName(docs.limit(3), True)
    assert near_dedup.Parameters().distance == 31 and corpus_pipeline.NEAR.distance == 37
    clean = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert clean.columns == docs.columns and 0 < clean.count() <= docs.count()
    assert corpus_pipeline.drop_toxic(spark, wide, SF).columns == wide.columns
    single = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    by_hand = components_by_hand({r["doc_id"]: r["text"] for r in docs.collect()}, 80)  # a stage's similarity
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(i for i, (_, c) in by_hand.items() if i == c)
    again = corpus_pipeline.drop_near_duplicates(spark, docs.unionByName(docs.limit(9)), SF)
    assert again.count() == single.count()
    mixed = corpus_pipeline.mix_sources(spark, wide, SF)
    assert mixed.count() == wide.count()
    order = {r["doc_id"]: (r["slot"], r["place"]) for r in mixing.mix(docs).collect()}
    placed = [order[r["doc_id"]] for r in corpus_pipeline.mix_sources(spark, docs, SF).collect()]
    assert placed == sorted(placed)
    assert corpus_pipeline.encode(spark, docs, SF).where("n_tokens > 0").count() == docs.where("text <> ''").count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), SF).count() == 0
    assert set(corpus_pipeline.run(spark, SF).columns) >= {"doc_id", "source", "tokens"}


def test_pipeline_keeps_clashing_columns(spark, tmp_path):
    docs = sample_docs(spark).withColumns({c: F.lit(c) for c in ("tokens", "n_tokens", "position", "score", "kept", "component_id", "decoded")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    done = corpus_pipeline.run(spark, str(tmp_path))
    assert set(done.columns) == {*docs.columns, "position_", "tokens_", "n_tokens_"} - {"text"}
    assert all((r["tokens"], r["n_tokens"], r["position"]) == ("tokens", "n_tokens", "position") for r in done.collect())


def test_pipeline_rows_have_their_place_in_the_mixture(spark):
    rows = sorted(corpus_pipeline.run(spark, SF).collect(), key=lambda r: r["position"])
    kept = spark.createDataFrame([(r["doc_id"], r["source"]) for r in rows], "doc_id long, source string")
    order = sorted(mixing.mix(kept).collect(), key=lambda r: (r["slot"], r["place"]))
    assert len(rows) > 50 and [r["doc_id"] for r in rows] == [r["doc_id"] for r in order]
    # null and repeated doc_ids have places of their own, in their sources' blocks
    docs = edge_docs(spark, False).union(spark.createDataFrame([(None, "x", "src0"), (None, "x", "src1")], edge_docs(spark, False).schema))
    mixed = corpus_pipeline.mix_sources(spark, docs.withColumn("position", F.lit("own")), SF).collect()
    assert len({r["position_"] for r in mixed}) == len(mixed) == docs.count() and {r["position"] for r in mixed} == {"own"}
    assert all(r["position_"] is not None for r in mixed)
    sources = {r["slot"] * mixing.Parameters().block + r["place"]: r["source"] for r in mixing.mix(docs).collect()}
    found = {r["position_"]: r["source"] or mixing.NULL_SOURCE for r in mixed}
    assert sorted(sources) == sorted(found)
    assert sorted(sources.values()) == sorted(found.values())


def test_toxicity_knows_sequences_and_rare_words(spark):
    rows = [(i, "green apple red pear " * 3, 0) for i in range(40)] + [(100 + i, "green pear red apple " * 3, 1) for i in range(40)]
    rows += [(500, "seldom", 1)]
    sample = spark.createDataFrame(rows, "doc_id long, text string, toxic int").select("doc_id", "toxic", "text")
    p = toxicity.Parameters()
    model = toxicity.kneser_ney(toxicity.bigram_counts(sample), p)
    # the same ordinary words, in another order
    assert model.ratios("green pear red apple").mean() > 1 and model.ratios("green apple red pear").mean() < -1
    assert abs(model.ratios("seldom")[0]) > 0 and len(model.ratios("")) == 0
    # by hand: P(pear | green) of each class
    contexts = {0: {"green": 2, "apple": 1, "red": 1, "pear": 1}, 1: {"green": 2, "pear": 1, "red": 1, "apple": 1, "seldom": 1}}
    shared = {w: sum(c.get(w, 0) for c in contexts.values()) + 0.5 for c in contexts.values() for w in c}
    whole = sum(shared.values()) + 2 * 0.5  # the empty word and all unseen words
    each = []
    for c, (own, n) in enumerate([(0, 120), (120, 120)]):
        total, types = sum(contexts[c].values()), len(contexts[c])
        lower = max(contexts[c]["pear"] - p.discount, 0) / total + p.discount * types / total * shared["pear"] / whole
        each.append(max(own - p.discount, 0) / n + p.discount * 1 / n * lower)
    assert abs(model.ratios("green pear")[1] - np.log(each[1] / each[0])) < 1e-4
    # every word sums to one after any history, over all seen words and the unseen
    for v in ("green", "seldom", ""):
        at = model.words[v] * model.lower.shape[1] + np.arange(model.lower.shape[1])
        for c in (0, 1):
            found = dict(zip(model.keys.tolist(), model.counts[c].tolist(), strict=True))
            own = sum(max(found.get(int(k), 0.0) - p.discount, 0) for k in at) / max(model.seen[c, model.words[v]], 1)
            assert abs(own + model.back_off[c, model.words[v]] * model.lower[c].sum() - 1) < 1e-5
