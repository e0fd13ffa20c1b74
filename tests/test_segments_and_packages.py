import hashlib
import random

from ledgerloom.operators import packages, segments
from pyspark.sql import functions as F


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


TEXT = "intro\n# One\nbody\n## A\nx\n### Deep\n## B\r\ny\n# Two\nend"


def test_section_ranges(spark):
    df = spark.createDataFrame([(1, TEXT, "clash"), (2, None, "c"), (3, "", "c"), (4, "no heading", "c")], "doc_id bigint, text string, level string").select("doc_id", "text")
    got = {r.title: TEXT[r.start : r.end] for r in segments.section_spans(df).collect()}
    assert got == {"One": "# One\nbody\n## A\nx\n### Deep\n## B\r\ny\n", "A": "## A\nx\n### Deep\n", "Deep": "### Deep\n", "B": "## B\r\ny\n", "Two": "# Two\nend"}


def test_outline_paths(spark):
    df = spark.createDataFrame([(1, "### Low\n# One\n### Deep\n## Mid\n### Leaf\n# Two\n## Last")], "doc_id bigint, text string")
    got = [r.path for r in segments.outline_paths(df).orderBy("line_no").collect()]
    assert got == ["Low", "One", "One/Deep", "One/Mid", "One/Mid/Leaf", "Two", "Two/Last"]


def test_siblings_and_quota(spark):
    df = spark.createDataFrame([("p", i) for i in range(60)] + [("q", 1)], "p string, i int")
    got = segments.sibling_groups(df, "p", "i").groupBy("p", "group_no").count()
    assert rows(got) == sorted([("p", 1, 29), ("p", 2, 29), ("p", 3, 2), ("q", 1, 1)], key=repr)
    assert segments.quota(df, "p", [F.col("i")], 3).count() == 4


def test_sentences(spark):
    df = spark.createDataFrame([("a", "The lock was held by two. Is it so? It might be that way now. Two words. The node took 4.2 ms in all!"), ("n", None), (None, "The lock was held by two.")], "id string, t string")
    assert rows(segments.factual_sentences(df, "id", "t")) == [("a", 1, "The lock was held by two."), ("a", 5, "The node took 4.2 ms in all!")]


def test_best_span_ties(spark):
    df = spark.createDataFrame([("a", "locks held twice", "None here. The locks were held. They held the locks."), ("b", "of it", "of it."), ("c", None, "x"), ("d", "locks", None), ("e", "other", "none")], "id string, c string, t string")
    assert rows(segments.best_span(df, "id", "c", "t")) == [("a", 2, 2, 0.6667)]


def test_years_symbols(spark):
    df = spark.createDataFrame([(1, "In 2024 and 1999, not 12024 or 4.2024.1 or 2024; 2101"), (2, "```py\ndef run(x):\nclass A:\n```\ndef no():\n```\n[table.x]\n"), (3, None)], "doc_id bigint, text string")
    assert [r[0] for r in df.where("doc_id = 1").select(segments.years(F.col("text"))).collect()] == [["1999", "2024"]]
    assert rows(segments.symbols(df)) == sorted([(2, "function", "run"), (2, "class", "A"), (2, "table", "table.x")], key=repr)


def test_exact_first(spark):
    s = "query_id string, doc_id bigint, score double"
    e = spark.createDataFrame([("q", 5, 1.0), ("q", 7, 1.0)], s)
    r = spark.createDataFrame([("q", 1, 9.0), ("q", 5, 8.0), ("q", 2, 3.0)], s)
    assert [(x.doc_id, x.method) for x in packages.exact_first(e, r, 3).orderBy("rank").collect()] == [(5, "exact"), (7, "exact"), (1, "bm25")]


def test_suffixes_drift_first_seen(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("a", 4)], "n string, i int")
    assert [r.unique_name for r in packages.suffixed(df, "n", "i").orderBy("i").collect()] == ["a", "a-1", "b", "a-2"]
    b = spark.createDataFrame([("1", "x"), ("2", "x"), ("3", None), ("4", "x")], "id string, content_hash string")
    c = spark.createDataFrame([("1", "x"), ("2", "y"), ("3", "x"), ("5", "x")], "id string, content_hash string")
    assert rows(packages.content_drift(b, c)) == [("1", "unchanged"), ("2", "drifted"), ("3", "unknown"), ("4", "gone"), ("5", "new")]
    old = spark.createDataFrame([("k", 3), ("k", 2)], "id string, at int")
    assert rows(packages.first_seen(old, spark.createDataFrame([("k", 9), ("m", 8)], "id string, at int"), "id", "at")) == [("k", 2), ("m", 8)]


def test_heights(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "x"), ("p", "q"), ("q", "p"), ("q", "r"), (None, "z")], "child string, parent string")
    assert rows(packages.heights(e)) == [("a", 0), ("b", 1), ("c", 2)]
    chain = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(70)], "child string, parent string")
    assert rows(packages.heights(chain)) == [(f"{i:03d}", i) for i in range(71)]


def test_packages_do_not_depend_on_order(spark):
    items = [("k", str(i), None if i % 7 == 0 else str(i * i)) for i in range(50)]
    schema = "k string, a string, b string"
    one = packages.packages(spark.createDataFrame(items, schema), "k", ["a", "b"]).first()
    random.Random(1).shuffle(items)
    two = packages.packages(spark.createDataFrame(items + items[:3], schema).repartition(5), "k", ["a", "b"]).first()
    other = packages.packages(spark.createDataFrame(items[1:], schema), "k", ["a", "b"]).first()
    assert one == two != other and one.n_items == 50
    digests = [hashlib.sha256(f"{a}\x1f{chr(0) if b is None else b}".encode()).hexdigest() for _, a, b in items]
    sums = ":".join(str(sum(int(d[10 * i : 10 * i + 10], 16) for d in digests)) for i in range(6))
    assert one.package_hash == hashlib.sha256(f"50:{sums}".encode()).hexdigest()


def test_signals_and_cleaning(spark):
    m = spark.createDataFrame([(3, None)], "n int, r double")
    assert rows(packages.threshold_signals(m, [("some", "info", F.col("n") > 0), ("rate", "warning", F.col("r") < 1)])) == [("some", "info")]
    t = spark.createDataFrame([("It held [3] , then [[Sources/x|x]] fell .  ",)], "t string")
    assert t.select(packages.without_citations(F.col("t"))).first()[0] == "It held, then fell."
    b = spark.createDataFrame([("Sign in\nText\n\n\n\n Read more about it \n SHARE\nmore\n",), (None,)], "t string")
    assert [r[0] for r in b.select(packages.without_boilerplate(F.col("t"))).collect()] == ["Text\n\nmore", None]
    q = spark.createDataFrame([("“ﬁne” – ok",), ("plain",), (None,)], "t string")
    assert [r[0] for r in q.select(packages.folded_punctuation(F.col("t"))).collect()] == ['"fine" - ok', "plain", None]
