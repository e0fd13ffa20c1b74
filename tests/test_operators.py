"""Hand-checked and brute-force tests of the relational operators."""

import itertools
import math
import random
from collections import Counter, defaultdict

import pytest
from ledgerloom.functions.skew import salted_join
from ledgerloom.operators import graph, notes, quality, retrieval, similarity
from ledgerloom.operators.components import components
from pyspark.sql import functions as F


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "a string, b string")


TRIANGLES = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("d", "f")]


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "red fox, red hen"), (2, "fox"), (3, None), (4, "")], "doc_id bigint, text string")
    q = spark.createDataFrame([("q", "Red red fox zebra"), ("n", None)], "query_id string, text string")
    n, avg = 4, 5 / 4
    idf = lambda df: math.log((n - df + 0.5) / (df + 0.5) + 1)
    part = lambda tf, dl: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    want = {1: 2 * idf(1) * part(2, 4) + idf(2) * part(1, 4), 2: idf(2) * part(1, 1)}
    got = {r.doc_id: r.score for r in retrieval.bm25(docs, q).collect()}
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}
    assert [r.doc_id for r in retrieval.ranked(retrieval.bm25(docs, q), 1).collect()] == [1]


def test_fusion_and_ties(spark):
    a = spark.createDataFrame([("q", 1, 2.0), ("q", 2, 2.0)], "query_id string, doc_id bigint, score double")
    b = spark.createDataFrame([("q", 2, 5.0)], "query_id string, doc_id bigint, score double")
    assert rows(retrieval.fused(a, b, 5)) == [("q", 1, pytest.approx(1 / 61, abs=1e-6), 2), ("q", 2, pytest.approx(1 / 62 + 1 / 61, abs=1e-6), 1)]


def test_retrieval_metrics(spark):
    h = spark.createDataFrame([("q", 1), ("q", 2), ("r", 9)], "query_id string, doc_id bigint")
    rel = spark.createDataFrame([("q", 1), ("q", 3), ("s", 4)], "query_id string, doc_id bigint")
    assert rows(retrieval.retrieval_metrics(h, rel)) == [(3, 0.25, 0.3333, 0.75)]


def test_notes(spark):
    text = "---\ntitle: 'A b'\nsource_id: src-1\n---\n# One\n## Key Claims\n\n- first   claim\nnot one\n* second\n## Two\n### Deep\n# Three\n"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "---\nno end")], "doc_id bigint, text string")
    assert rows(notes.frontmatter(df, ("title", "source_id", "none"))) == [(1, "A b", "src-1", None)]
    assert rows(notes.bullets(df, "Key Claims")) == [(1, 1, "first claim"), (1, 2, "second")]
    assert sorted(rows(notes.headings(df)), key=lambda r: r[1]) == [(1, 5, 1, "One", None), (1, 6, 2, "Key Claims", 5), (1, 11, 2, "Two", 5), (1, 12, 3, "Deep", 11), (1, 13, 1, "Three", None)]


def test_chunks_cover_the_text(spark):
    df = spark.createDataFrame([(i, "x" * n) for i, n in enumerate([0, 1, 10000, 10001, 19000, 19001, 28500])], "doc_id bigint, text string")
    got = defaultdict(list)
    for r in notes.chunks(df).collect():
        got[r.doc_id].append((r.start, r.n_chars))
    assert 0 not in got
    for i, n in enumerate([0, 1, 10000, 10001, 19000, 19001, 28500]):
        if n:
            s = sorted(got[i])
            assert s[-1][0] + s[-1][1] == n and all(b[0] - a[0] == 9000 for a, b in zip(s, s[1:])) and all(c <= 10000 for _, c in s)


def test_urls_ids_anchors(spark):
    df = spark.createDataFrame([("https://a.example/x?utm_source=1&b=&gclid=2&c=3#f",), ("https://a.example/?fbclid=1",), ("plain",)], "u string")
    assert [r[0] for r in df.select(notes.canonical_url(F.col("u"))).collect()] == ["https://a.example/x?b=&c=3", "https://a.example/", "plain"]
    a = spark.createDataFrame([("page=2",), ("L3=L9",), ("L4",), ("seg-7",), ("section=x",), ("page=99999999999",), (None,)], "anchor string")
    assert rows(notes.anchor_parts(a)) == sorted([("page=2", "page", 2, None), ("L3=L9", "lines", 3, 9), ("L4", "lines", 4, None), ("seg-7", "segment", 7, None), ("section=x", "section", None, None), ("page=99999999999", "page", None, None)], key=repr)
    one = spark.range(1).select(notes.claim_key(F.lit("C"), F.lit(" t ")).alias("k"), notes.slug(F.lit(" A  b! ")).alias("s")).first()
    import hashlib

    assert one.k == "clm-" + hashlib.sha256(b"C:t").hexdigest()[:10] and one.s == "a-b"


def test_kappa_confusion_wilson(spark):
    p = spark.createDataFrame([("x", "x")] * 2 + [("y", "y")] + [("x", "y")] + [(None, "x")], "a string, b string")
    assert rows(quality.kappa(p)) == [(4, 0.75, 0.5)]
    dom = spark.createDataFrame([("x",), ("y",)], "label string")
    assert rows(quality.confusion(p, dom)) == [("x", "x", 2), ("x", "y", 1), ("y", "x", 0), ("y", "y", 1)]
    assert quality.kappa(p.limit(0)).first().kappa is None
    low, high = quality.wilson(F.lit(0), F.lit(84))
    r = spark.range(1).select(low, high).first()
    assert (r[0], round(r[1], 3)) == (0.0, 0.044)


def test_ledgers(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("k", 2, "c"), (None, 3, "d"), ("m", None, None)], "id string, v int, x string")
    assert rows(quality.latest(df, "id", "v")) == [("k", 2, "c"), ("m", None, None)]
    assert rows(quality.first_written(df, "id", "v")) == [("k", 1, "a"), ("m", None, None)]
    assert rows(quality.repeated(df, "id")) == [(4, 2, 0.5, 1)]
    assert rows(quality.drift(df, df)) == []
    assert rows(quality.drift(df.limit(0), df.where("id = 'm'"))) == [("fresh", "m", None, None)]


def test_issues(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 1), (None, 2)], "id string, x int")
    assert rows(quality.issues(df, "t", "id", {"x-missing": F.col("x").isNotNull(), "id-missing": F.col("id").isNotNull()})) == [("t", "a", "x-missing"), ("t", "unknown", "id-missing")]


def test_roots(spark):
    parent = [("a", "b"), ("b", "c"), ("c", None), ("l", "l"), ("x", "y"), ("y", "z"), ("z", "y"), ("u", "gone"), ("n", None)]
    got = {r.id: (r.root, r.depth, r.cyclic) for r in graph.roots(spark.createDataFrame(parent, "id string, parent string")).collect()}
    assert got == {"a": ("c", 2, False), "b": ("c", 1, False), "c": ("c", 0, False), "l": ("l", 0, False), "x": ("y", -1, True), "y": ("y", -1, True), "z": ("y", -1, True), "u": ("gone", 1, False), "gone": ("gone", 0, False), "n": ("n", 0, False)}


def test_roots_of_a_long_chain(spark):
    got = graph.roots(spark.createDataFrame([(f"{i:04d}", f"{i + 1:04d}") for i in range(150)], "id string, parent string"))
    assert {(r.root, r.depth) for r in got.where("id = '0000'").collect()} == {("0150", 150)}


def test_reach_components(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), (None, "q")])
    start = spark.createDataFrame([("a",)], "node string")
    assert rows(graph.reach(e, start, 9)) == rows(graph.reach(e, start)) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert rows(graph.reach(e, start, 1)) == [("a", 0), ("b", 1)]
    typed = e.withColumn("relation", F.when(F.col("a") == "x", "far").otherwise("near"))
    names = spark.createDataFrame([(n, f"the {n.upper()}") for n in "abcdxy"], "node string, name string")
    assert rows(graph.traverse(typed, names, "The d", 1)) == [("c", 1), ("d", 0)] and rows(graph.traverse(typed, names, "THE", 9, ("far",), 6)) == [(n, 0) for n in "abcdxy"]
    assert rows(components(e, "a", "b")) == [(n, "a") for n in "abcd"] + [("x", "x"), ("y", "x")]
    chain = edges(spark, [(f"{i:02d}", f"{i + 1:02d}") for i in range(40)])
    assert {r.label for r in components(chain, "a", "b").collect()} == {"00"}


def test_communities_of_two_triangles(spark):
    e = edges(spark, TRIANGLES).withColumn("weight", F.lit(1.0))
    found = graph.communities(e)
    assert rows(found) == [(n, "a") for n in "abc"] + [(n, "d") for n in "def"]
    assert graph.modularity(e, found).first()[0] == pytest.approx(6 / 7 - 0.5, abs=1e-4)
    assert rows(graph.community_report(graph.undirected(e), found)) == [("a", 3, 3, 1, 1, False), ("d", 3, 3, 1, 1, False)]
    assert graph.communities(e.limit(0)).count() == 0


def test_communities_reach_a_good_modularity(spark):
    r = random.Random(3)
    e = [(f"n{i:02d}", f"n{j:02d}", 1.0) for i, j in itertools.combinations(range(40), 2) if r.random() < (0.6 if i % 4 == j % 4 else 0.03)]
    df = spark.createDataFrame([*e, ("n00", "n00", 9.0), (None, "n01", 1.0)], "a string, b string, weight double")
    found = graph.communities(df)
    plain = df.where("a <> b")
    planted = spark.createDataFrame([(f"n{i:02d}", str(i % 4)) for i in range(40)], "node string, community string")
    q = lambda c: graph.modularity(plain, c).first()[0]
    assert q(found) > 0.85 * q(planted)


def test_betweenness_of_two_triangles(spark):
    for blocks in (1, 3):
        got = {r.node: r.betweenness for r in graph.betweenness(edges(spark, TRIANGLES), blocks).collect()}
        assert got == {"a": 0.0, "b": 0.0, "c": 6.0, "d": 6.0, "e": 0.0, "f": 0.0}
    path = graph.betweenness(edges(spark, [("a", "b"), ("b", "c"), ("a", "d"), ("d", "c"), ("c", "e"), ("x", "y")]))
    assert rows(path) == [("a", 0.5), ("b", 1.0), ("c", 3.5), ("d", 1.0), ("e", 0.0), ("x", 0.0), ("y", 0.0)]


def test_eigenvector_and_hubs(spark):
    got = {r.node: r.score for r in graph.eigenvector(edges(spark, TRIANGLES)).collect()}
    assert got["c"] == got["d"] == 1.0 and got["a"] == got["b"] == got["e"] < 1
    star = edges(spark, [("h", str(i)) for i in range(20)])
    assert rows(graph.hubs(graph.degrees(star))) == [("h", 20)]


def test_pair_signals_against_brute_force(spark):
    r = random.Random(1)
    items = [(o, i) for o in "abcdef" for i in range(12) if r.random() < 0.5]
    own = defaultdict(set)
    for o, i in items:
        own[o].add(i)
    df = spark.createDataFrame([*items, items[0], (None, 1), ("a", None)], "owner string, item int")
    n = len({i for _, i in items})
    pmi, jac = {}, {}
    for x, y in itertools.combinations(sorted(own), 2):
        s = len(own[x] & own[y])
        if s:
            pmi[x, y], jac[x, y] = round(math.log2(s * n / (len(own[x]) * len(own[y]))), 3), round(s / len(own[x] | own[y]), 6)
    assert {(a, b): p for a, b, _, p in rows(graph.pointwise_information(df))} == {k: pytest.approx(v, abs=1e-3) for k, v in pmi.items()}
    assert {(a, b): p for a, b, p in rows(graph.jaccard(df, 0.0))} == jac


def test_triads_gravity_activation(spark):
    p = graph.undirected(edges(spark, TRIANGLES))
    assert rows(graph.open_triads(p, 1)) == sorted([("a", "d", 1), ("b", "d", 1), ("c", "e", 1), ("c", "f", 1)], key=repr)
    assert {r.gravity for r in graph.gravity(p, 1.5).collect()} == {1.5}
    assert rows(graph.one_way_links(edges(spark, [("a", "b"), ("b", "a"), ("c", "a")]))) == [("c", "a")]


def test_cosine_pairs_are_exact(spark):
    r = random.Random(5)
    words = [c * 3 for c in "abcdefghijkl"]
    texts = [(str(i), " ".join(r.choices(words, weights=range(1, 13), k=r.randrange(1, 9)))) for i in range(40)] + [("n", None), ("e", "12")]
    w = similarity.tfidf(spark.createDataFrame(texts, "id string, text string")).cache()
    vec = defaultdict(dict)
    for i, t, x in w.collect():
        vec[i][t] = x
    assert all(abs(sum(x * x for x in v.values()) - 1) < 1e-9 for v in vec.values())
    want = {(a, b): s for a, b in itertools.combinations(sorted(vec), 2) if (s := sum(x * vec[b].get(t, 0) for t, x in vec[a].items())) >= 0.6}
    got = {(r.a, r.b): r.cosine for r in similarity.cosine_pairs(w, 0.6).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_nearest_in_blocks(spark):
    v = spark.createDataFrame([(i, [math.cos(i), math.sin(i)], i % 3) for i in range(30)] + [(99, None, 1)], "vec_id bigint, embedding array<float>, label int")
    q = v.where("vec_id % 5 = 0")
    one, many = rows(similarity.nearest(v, q, 3)), rows(similarity.nearest(v, q, 3, block=2))
    assert one == many and len(one) == 18
    best = {r[0]: r[1] for r in one if r[4] == 1}
    assert all(abs(math.cos(i - best[i])) <= 1 and best[i] == max((j for j in range(30) if j != i), key=lambda j: (round(math.cos(i - j), 5), -j)) for i in best)


def test_salted_join_equals_a_plain_one(spark):
    many = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(300)] + [(None, 1)], "k string, x int")
    few = spark.createDataFrame([("hot", 1), ("k3", 2), ("k9", 3), (None, 4)], "k string, y int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert Counter(map(tuple, salted_join(many, few, ["k"], ["x"], how).collect())) == Counter(map(tuple, many.join(few, "k", how).collect()))


def test_spread_keeps_rows_and_leaves_wide_plans(spark):
    from ledgerloom.functions.spread import spread

    one = spark.range(100).coalesce(1)
    assert spread(one).rdd.getNumPartitions() == 4 and spread(one).count() == 100
    wide = spark.range(0, 100, 1, 3)
    assert spread(wide) is wide


def test_gravity_three_steps_apart_and_converged_eigenvector(spark):
    p = graph.undirected(edges(spark, TRIANGLES))
    assert {(x.a, x.b): round(x.gravity, 6) for x in graph.gravity(p, 0.4).collect()} == {("a", "d"): 1.5, ("b", "d"): 1.5, ("c", "e"): 1.5, ("c", "f"): 1.5, **{(a, b): round(4 / 9, 6) for a in "ab" for b in "ef"}}
    path = [(f"n{i}", f"n{i + 1}") for i in range(8)]
    got = {r.node: r.score for r in graph.eigenvector(graph.undirected(edges(spark, path))).collect()}
    assert got == {f"n{i}": pytest.approx(math.sin((i + 1) * math.pi / 10), abs=1e-4) for i in range(9)}


def test_activation_of_every_seed(spark):
    links = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("e", "a"), ("x", "y"), ("y", "z"), ("z", "x"), ("a", "a")]
    out = defaultdict(list)
    for a, b in links:
        if a != b:
            out[a].append(b)
    seeds = sorted(out, key=lambda n: (-len(out[n]), n))
    linked = {(a, b) for a, b in links} | {(b, a) for a, b in links}

    def want(seeds):
        found = {}
        for s in seeds:
            held = {s: 1.0}
            for _ in range(3):
                new = defaultdict(float)
                for n, m in held.items():
                    for o in out[n]:
                        new[o] += m * 0.5 / len(out[n])
                for n, m in new.items():
                    held[n] = held.get(n, 0.0) + m
            found |= {(s, n): pytest.approx(m, abs=1e-5) for n, m in held.items() if n != s and (s, n) not in linked}
        return found

    e = edges(spark, links)
    for n in (20, 2):
        assert {(x.seed, x.node): x.activation for x in graph.seeded_activation(e, n).collect()} == want(seeds[:n])


def test_steering_matches(spark):
    phrases = ["Ignore previous instruction", "disregard the system prompt", "you are now ", "Act as a unrestricted", "</system>", "### Override", "forget everything you have learned", "JAILBREAK"]
    texts = [(str(i), f"first line\n \t{p} and more\n{p}") for i, p in enumerate(phrases)] + [("all", "\n".join(p + " x" for p in phrases)), ("in", "do not ignore all instructions"), ("cr", "x\rjailbreak"), ("none", None)]
    got = {x.doc_id: x.matches for x in notes.steering_matches(spark.createDataFrame(texts, "doc_id string, text string")).collect()}
    assert got == {str(i): [p.strip()] for i, p in enumerate(phrases)} | {"all": [p.strip() for p in phrases]}


def test_best_documents_equal_the_full_ranking(spark):
    r = random.Random(12)
    words = ["the", "of"] * 12 + [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(r.choices(words, k=r.randrange(1, 40)))) for i in range(200)] + [(900, None), (901, "")], "doc_id bigint, text string")
    q = spark.createDataFrame([("common", "the of the"), ("rare", "w1 w2 the of"), ("one", "w3"), ("none", "zzz"), ("null", None), ("mixed", "of w4 w5 w6 w4")], "query_id string, text string")
    keep = docs.where("doc_id % 3 > 0").select("doc_id")
    full = retrieval.bm25(docs, q)
    for k in (1, 5, 60):
        assert rows(retrieval.bm25_best(docs, q, k)) == rows(retrieval.ranked(full, k))
        assert rows(retrieval.bm25_best(docs, q, k, keep)) == rows(retrieval.ranked(full.join(keep, "doc_id", "left_semi").select("query_id", "doc_id", "score"), k))
    assert retrieval.bm25_best(docs.limit(0), q, 3).count() == retrieval.bm25_best(docs, q.limit(0), 3).count() == 0
