"""Search, quotes, grades, page grammar, audits and proposals on small fixtures."""

import hashlib

import pytest
from ledgerloom.operators import clauses, notes, pages, proposals, ranking, segments, upkeep, verification
from pyspark.sql import functions as F


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_node_search_against_counting(spark):
    data = [("alpha lock", "Alpha Lock", "the lock of alpha locks", ["lock"]), ("beta", "Beta", None, None), ("gamma", None, "alpha", []), ("delta", "Lock", "", ["x"])]
    nodes = spark.createDataFrame([(*n, "clash") for n in data], "node string, title string, text string, tags array<string>, term string")
    q = spark.createDataFrame([("q1", "Lock lock alpha?"), ("q2", "zeta"), ("q3", None), (None, "lock")], "query_id string, text string")
    edges = spark.createDataFrame([("alpha lock", "beta"), ("beta", "gamma"), ("delta", "nowhere"), ("alpha lock", "beta")], "a string, b string")
    want = {}
    for node, title, text, tags in data:
        s = sum(3 * (title or "").lower().count(t) + (text or "").lower().count(t) + " ".join(tags or []).lower().count(t) + node.count(t) for t in ("lock", "lock", "alpha"))
        if s:
            want[node] = float(s)
    got = ranking.node_search(nodes, edges, q, 10, "lexical").collect()
    assert {r.doc_id: r.score for r in got} == want and {r.query_id for r in got} == {"q1"}
    g = {r.doc_id: r.score for r in ranking.node_search(nodes, edges, q, 10, "graph").collect()}
    assert g == {"alpha lock": 5.0, "delta": 4.0, "gamma": 2.0, "beta": 1.0}
    fused = {r.doc_id: r.score for r in ranking.node_search(nodes, edges, q, 10).collect()}
    assert fused["alpha lock"] == pytest.approx(2 / 61, abs=1e-6) and fused["beta"] == pytest.approx(1 / 64, abs=1e-6)
    assert ranking.node_search(nodes.limit(0), edges, q, 3).count() == ranking.node_search(nodes, edges, q.limit(0), 3).count() == 0
    k = ranking.keyword_search(spark.createDataFrame([("a", "Lock lock"), ("b", None), ("c", "lockless"), ("a", "Lock lock")], "id string, text string"), ["LOCK", ""], 5)
    assert rows(k) == [("a", 2), ("c", 1)]


def test_quotes(spark):
    long = "filler words " * 5000
    sources = spark.createDataFrame([("s", f"{long} The quick brown fox — it jumped\nover the “lazy” dog. café closed early. {long}", "x"), ("s", "another text", "x"), ("n", None, "x")], "source_id string, text string, quote string")
    quotes = ["quick brown fox", "fox - it jumped over the \"lazy\" dog", "café closed early", "The quick brown … the lazy dog", "The quick brown ... over the \"lazy\"", "over the \"lazy\" … quick brown", "fox … lazy dog", "Fo", "The", "not there at all", "  ", None]
    a = spark.createDataFrame([("c", i, "s", q) for i, q in enumerate(quotes, 1)] + [("c", 90, "n", "quick brown"), ("c", 91, None, "quick brown"), ("d", 1, "s", "quick brown fox"), ("d", 1, "s", "quick brown fox")], "claim_id string, item_no int, source_id string, quote string")
    got = verification.verify_quotes(a, sources)
    want = {1: "exact", 2: "normalized", 3: "normalized", 5: "ellipsis", 9: "exact"}
    assert {r.item_no: (r.status, r.match) for r in got.where("claim_id = 'c'").collect()} == {i: ("verified", want[i]) if i in want else ("failed", None) for i in range(1, 11)} | {90: ("unverifiable", None), 91: ("unverifiable", None)}
    claims = spark.createDataFrame([("c",), ("d",), ("e",), (None,)], "claim_id string")
    assert rows(verification.claim_verdicts(claims, got)) == [("c", "failed", 12), ("d", "verified", 1), ("e", "absent", 0)]
    assert verification.verify_quotes(a.limit(0), sources).count() == 0 and verification.verify_quotes(a, sources.limit(0)).where("status <> 'unverifiable'").count() == 0


def test_grades(spark):
    q = [("ok", ["broker sealed quickly"], None, "answer", False), ("half", ["broker sealed", "unseen wording entirely"], None, None, None), ("few", ["alpha bravo", "delta gamma", "omega sigma"], [], "answer", None), ("bad", None, ["it was Safe"], "answer", True), ("abstain", ["x"], None, "abstain", None), ("fake", [None], None, "answer", None), ("none", ["y"], None, "answer", None), (None, ["y"], None, "answer", None)]
    a = [("ok", "The BROKER was sealed."), ("half", "broker sealed"), ("few", "alpha bravo"), ("bad", "We say it was safe."), ("abstain", "There is insufficient evidence."), ("fake", "see src-0123456789 and src-aaaaaaaaaa"), ("none", None)]
    g = verification.grades(spark.createDataFrame(q, "id string, facts array<string>, forbidden array<string>, behavior string, unsure boolean"), spark.createDataFrame(a, "id string, text string"), spark.createDataFrame([("src-aaaaaaaaaa",)], "id string"))
    assert rows(g) == [("abstain", 1.0, "", "pass"), ("bad", 1.0, "forbidden-conclusion,missing-uncertainty", "catastrophic"), ("fake", 1.0, "fabricated-citation", "catastrophic"), ("few", 0.333, "missing-elements", "fail"), ("half", 0.5, "", "pass"), ("none", 1.0, "", "pass"), ("ok", 1.0, "", "pass")]
    r = verification.grade_rates(g.withColumn("tier", F.lit(None).cast("string")), ("tier",)).where("tier IS NULL").first()
    assert (r.n, r.pass_rate, r.catastrophic_rate) == (7, round(4 / 7, 4), round(2 / 7, 4))


def test_setups(spark):
    asked = spark.createDataFrame([(s, i, t) for s in ("plain", "governed") for i, t in (("q1", "decision"), ("q2", "exploratory"), ("q3", None))], "setup string, id string, tier string")
    got = spark.createDataFrame([("plain", "q1", "bad"), ("plain", "q1", "good"), ("plain", "q2", "good"), ("governed", "q1", "good"), ("governed", "q2", "other"), ("plain", "q2", None)], "setup string, id string, source_id string")
    rel = spark.createDataFrame([("q1", "good"), ("q1", "gone"), ("q2", "good"), ("q9", "good")], "id string, source_id string")
    states = spark.createDataFrame([("bad", True, True), ("good", False, False), ("other", False, False)], "source_id string, flagged boolean, revoked boolean")
    out = {r.setup: r for r in verification.setup_report(asked, got, rel, states, "plain").collect()}
    p, g = out["plain"], out["governed"]
    assert (p.n_questions, p.recall, p.coverage, p.irrelevant_rate, p.revoked_leaks, p.flagged_leaks, p.false_accepts, p.false_rejects, p.safe_grounded_rate, p.review_minutes) == (3, 0.75, 0.6667, 0.25, 1, 1, 1, 0, 0.3333, 4.0)
    assert (g.recall, g.flagged_leaks, g.false_rejects, g.safe_grounded_rate) == (0.25, 0, 1, 0.3333)
    c = verification.confusion_by(spark.createDataFrame([("k", "a", "b"), ("k", "a", "b")], "kind string, gold string, verdict string"), "kind", ("a", "b"))
    assert rows(c) == [("k", "a", "a", 0), ("k", "a", "b", 2), ("k", "b", "a", 0), ("k", "b", "b", 0)]


def test_page_grammar(spark):
    text = "a [[Sources/sub/src-0123456789#page=2&quote=so it is.|label]] b [x](../Sources/src-aaaaaaaaaa.md#L10=L12) (src-bbbbbbbbbb#seg-3), src-bbbbbbbbbb and src-0123456789#page=2 then [[Sources/src-0123456789#page=2]]"
    links = pages.source_links(spark.createDataFrame([("k", text), ("n", None), ("e", ""), (None, text)], "id string, text string"), "id", "text")
    assert rows(links) == [("k", 1, "src-0123456789", "page=2&quote=so it is."), ("k", 2, "src-aaaaaaaaaa", "L10=L12"), ("k", 3, "src-bbbbbbbbbb", "seg-3"), ("k", 4, "src-bbbbbbbbbb", None), ("k", 5, "src-0123456789", "page=2")]
    anchors = ["page=2&quote=so it is.", "L10=L12", "L7", "seg-3", "page=x&page=4", "line_start=3&line_end=9&commit=ab12", "section=one-two,", "extraction_confidence=0.5&segment=s1", "page=99999999999", None, ""]
    got = {r.anchor: r for r in spark.createDataFrame([(a,) for a in anchors], "anchor string").select("anchor", *(c.alias(n) for n, c in pages.anchor_fields(F.col("anchor")).items())).collect()}
    pick = lambda a: {k: v for k, v in got[a].asDict().items() if v is not None and k != "anchor"}
    assert [pick(a) for a in anchors] == [{"page": 2, "quote": "so it is"}, {"line_start": 10, "line_end": 12}, {"line_start": 7}, {"segment_id": "seg-3"}, {"page": 4}, {"line_start": 3, "line_end": 9, "commit": "ab12"}, {"section": "one-two"}, {"extraction_confidence": 0.5, "segment_id": "s1"}, {}, {}, {}]
    page = "## Key Claims\n\n- First  one [[Sources/src-0123456789|x]] .\n  wrapped\n* Second (src-aaaaaaaaaa)\n-no\n\n## Next\n- other"
    c = pages.page_claims(spark.createDataFrame([(1, "A", page), (2, None, page), (3, "B", None), (4, "B", "no section")], "doc_id int, concept string, text string"), "doc_id", "concept", "text")
    assert [(r.doc_id, r.claim_index, r.claim_text, r.n_links) for r in c.orderBy("claim_index").collect()] == [(1, 0, "First one.", 1), (1, 1, "Second", 1)]
    edges = "- `extends::` [[Concepts/Some_Page|x]]\n - `part_of::` [y](../Concepts/Other.md#a)\n- `likes::` [[Concepts/No]]\n`extends::` [[Concepts/No]]"
    assert rows(pages.typed_edges(spark.createDataFrame([("p", edges), ("n", None)], "id string, text string"), "id", "text")) == [("p", "extends", "Some_Page"), ("p", "part_of", "Other")]


def test_normal_forms(spark):
    assert one(spark, pages.title_of, "x\n# The  Title \n# Next") == "The  Title" and one(spark, pages.title_of, "none") is None and one(spark, pages.title_of, None) is None
    assert one(spark, pages.summary_of, "---\na: b\n---\n# T\n\n- list\n\nFirst\nparagraph.\n\nSecond.") == "First paragraph." and one(spark, pages.summary_of, "") is None
    assert [one(spark, pages.year_of, v) for v in ("2025-06-15", "20250615-101112", "in 1999", "12345", None)] == ["2025", "2025", "1999", "Unknown", "Unknown"]
    assert one(spark, lambda c: pages.authors_of(c, F.lit("Org")), [" A ", "unknown", None, "", "A", "Org"], "array<string>") == ["A", "Org"]
    assert [one(spark, pages.kind_of, v) for v in ("pdf", "news", None)] == ["paper-pdf", "news", "local-file"]
    assert one(spark, lambda c: pages.tags_of(c, F.lit("concept")), [" b ", "concept", "", "b"], "array<string>") == ["b", "vault/concept"]
    assert [one(spark, pages.name_key, v) for v in ("Open_Questions", "open-question", "gas", None)] == ["openquestion", "openquestion", "gas", None]
    assert [one(spark, pages.salvaged_object, v) for v in (' {"a": 1} ', 'so: {"a": {"b": 2}} done', "[1]", "{a", None)] == ['{"a": 1}', '{"a": {"b": 2}}', None, None, None]


def test_proposals(spark):
    text = "the broker of alpha sealed every pending ledger twice"
    r = [("a", text, ["s"], ["2020"], "e"), ("b", text + ".", ["s"], ["2020"], "e"), ("c", text, ["s"], ["2022"], "e"), ("d", text, ["t"], None, "e"), ("z", "something else entirely here", ["s"], [], "e"), ("n", None, ["s"], [], "e")]
    df = spark.createDataFrame(r, "id string, text string, scope array<string>, years array<string>, evidence string")
    got = {(x.a, x.b): (x.kind, x.dims) for x in proposals.duplicate_proposals(df, 0.9).collect()}
    assert got == {("a", "b"): ("merge", ""), ("c", "a"): ("supersede", "time"), ("c", "b"): ("supersede", "time"), ("a", "d"): ("needs-review", "scope,time"), ("b", "d"): ("needs-review", "scope,time"), ("c", "d"): ("needs-review", "scope,time")}
    assert rows(proposals.rename_proposals(spark.createDataFrame([("A_bc",), ("a-Bcs",), ("abc",), ("other",), (None,), ("--",)], "name string"))) == [("a-Bcs", "A_bc"), ("abc", "A_bc")]
    assert rows(proposals.archive_proposals(spark.createDataFrame([("x", "Stale", "retired"), ("y", None, "active"), ("y", None, "active"), (None, "stale", None)], "id string, quality string, status string"))) == [("x", "claim_quality=stale; status=retired")]
    pair = lambda *p: spark.createDataFrame(list(p), "a string, b string, x double")
    f = proposals.friction(pair(("a", "b", 0.5), ("a", "c", 0.5), ("b", "c", 0.28)).withColumnRenamed("x", "cosine"), pair(("a", "b", 0.5)).withColumnRenamed("x", "jaccard"), pair(("a", "c", 0.0)), pair(("b", "c", 0.0)), 0.25)
    assert rows(f) == [("a", "b", 0.25), ("b", "c", 0.38)]
    h = proposals.hub_pairs(spark.createDataFrame([("a", 1.0), ("b", 0.9), ("c", 0.9), ("d", 0.1), ("e", 0.1), ("f", 0.0)], "node string, score double"), pair(("a", "b", 0.0)), 0.5)
    assert rows(h) == [("a", "c", 0.9), ("b", "c", 0.81)]
    many = spark.createDataFrame([(f"n{i:03d}", 1 - i / 1000) for i in range(300)], "node string, score double")
    want = sorted(((-round((1 - i / 1000) * (1 - j / 1000), 6), f"n{i:03d}", f"n{j:03d}") for i in range(150) for j in range(i + 1, 150) if i))[:5]
    got = proposals.hub_pairs(many, many.select(F.lit("n000").alias("a"), F.col("node").alias("b")), 0.5, 5)
    assert sorted((-r.score, r.a, r.b) for r in got.collect()) == want
    m = proposals.merged_signals({"one": pair(("b", "a", 2.0), ("a", "c", 1.0), ("c", "d", 3.0)).withColumnRenamed("x", "score"), "two": pair(("a", "b", 5.0)).withColumnRenamed("x", "score")}, 2)
    assert rows(m) == [("a", "b", 2, 5.0, "one,two"), ("c", "d", 1, 3.0, "one")]
    assert rows(proposals.contrast_pairs(spark.createDataFrame([("a", "Unlike others it holds", ["b", "a"]), ("c", "plain", ["d"]), ("e", None, None)], "name string, text string, others array<string>"))) == [("a", "b")]


def test_compound_claims(spark):
    said = {
        "The broker writes rows; the cache stores keys": (["multi-predicate"], ["The broker writes rows.", "The cache stores keys."]),
        "Compile writes summaries and concept pages": ([], []),
        "In 2020 it was slow, since March it is fast": (["mixed-temporal"], []),
        "It is faster than before because of the disk": (["comparison-causal"], []),
        "The cache is faster because the disk fails": (["comparison-causal"], ["The cache is faster.", "The disk fails."]),
        "Teams should run lint because it catches errors": (["recommendation-fact"], ["Teams should run lint.", "It catches errors."]),
        "Teams should run lint": ([], []), "other than that": ([], []), "": ([], []),
    }
    df = spark.createDataFrame([(t,) for t in said] + [(None,), ("word " * 20000,)], "t string").select("t", clauses.categories(F.col("t")).alias("c"), clauses.statements(F.col("t")).alias("s"))
    got = {r.t: (r.c, r.s) for r in df.collect()}
    assert {t: got[t] for t in said} == said and got[None][0] is None
    assert clauses.third_person("verify") == "verifies" and clauses.third_person("catch") == "catches" and clauses.third_person("pass") == "passes"


def test_upkeep(spark):
    edges = spark.createDataFrame([("source", "s1", "claim", "c1"), ("source", "s1", "claim", "c2"), ("claim", "c1", "concept", "k"), ("claim", "c2", "concept", "k"), ("concept", "k", "answer", "9"), ("source", "s2", "claim", "c3"), ("source", "s1", "claim", "c1")], "from_type string, a string, to_type string, b string")
    t = upkeep.stale_targets(spark.createDataFrame([("v1", "s1"), ("v1", "s1"), ("v2", None), ("v2", "none")], "version string, source_id string"), edges)
    assert rows(t) == [("v1", "s1", "answer", "9"), ("v1", "s1", "claim", "c1"), ("v1", "s1", "claim", "c2"), ("v1", "s1", "concept", "k")]
    q = spark.createDataFrame([("v1", 1), ("v2", 2)], "version string, n int")
    e = spark.createDataFrame([(3, "v2"), (4, "v3")], "n int, version string")
    once = upkeep.upserted(q, e, "version")
    assert rows(once) == rows(upkeep.upserted(once, e, "version")) == [("v1", 1), ("v2", 3), ("v3", 4)]
    assert rows(upkeep.not_yet_emitted(e.unionByName(e), q, ["version"])) == [("v3", 4)]
    ref = lambda *x: spark.createDataFrame([(i,) for i in x], "ref string")
    r = upkeep.review_queue({"b": ("warning", ref("y", "x", None)), "a": ("error", ref("z", "z")), "c": ("warning", ref("w"))})
    assert rows(r) == [(1, "error", "a", "z"), (2, "warning", "b", "x"), (3, "warning", "b", "y"), (4, "warning", "c", "w")]
    docs = spark.createDataFrame([(1, "# Method: A b!\ntext\n## Results\nx\n# Method: A b!\ny"), (2, "plain"), (3, None), (4, "# !!!\n")], "doc_id bigint, text string")
    n = {(x.doc_id, x.node_id): (x.type, x.level, x.start, x.end) for x in upkeep.segment_nodes(segments.section_spans(docs), docs).collect()}
    assert n == {(1, "a-b"): ("method_section", 1, 0, 33), (1, "results"): ("results", 2, 20, 33), (1, "a-b-1"): ("method_section", 1, 33, 49), (2, "document"): ("document", 0, 0, 5), (4, "node-"): ("heading", 1, 0, 6)}
    b = upkeep.block_segments(notes.lines(spark.createDataFrame([(1, "| a | b |\n| - | - |\n\na | b | c\n![x](y)\nFigure 2: z\nno | table")], "doc_id bigint, text string")))
    assert rows(b) == [(1, "figure", 5, 5), (1, "figure", 6, 6), (1, "table", 1, 2), (1, "table", 4, 4)]
    budget = spark.createDataFrame([(0, 0), (1_995_996, 1), (3_993_996, 1)], "n bigint, k int").select(*(c.alias(x) for x, c in upkeep.compile_budget(F.col("n"), F.col("k")).items()))
    assert rows(budget) == [(1, 1000, "ok"), (498999, 1500, "warn"), (998499, 1500, "warn")]
    d = upkeep.run_drift(spark.createDataFrame([("a", "x"), ("b", "x"), ("c", None)], "id string, verdict string"), spark.createDataFrame([("a", "x"), ("b", "y"), ("d", "z"), ("c", None)], "id string, verdict string"))
    assert rows(d) == [("b", "x", "y", "changed"), ("d", None, "z", "new")]
    f = spark.createDataFrame([("a", None), ("a", None), ("b", "c")], "x string, y string").select(upkeep.fingerprint(F.col("x"), F.col("y")).alias("fingerprint"))
    assert upkeep.misses(f, f.limit(0)).count() == 2 and upkeep.misses(f, f).count() == 0
    many = spark.createDataFrame([("g", str(i)) for i in range(50)] + [("h", "1"), ("h", None)], "g string, k string")
    assert [r.k for r in upkeep.chosen_by_hash(many, "g", "k", 3).where("g = 'g'").orderBy("rank").collect()] == sorted(map(str, range(50)), key=lambda i: hashlib.md5(i.encode()).hexdigest())[:3]
