from datetime import datetime, timedelta

from ledgerloom.sources import vault
from ledgerloom.sources.html import bibliography, candidate_urls, to_text
from ledgerloom.streaming import ledgers
from ledgerloom.operators import notes

T = datetime(2026, 1, 1)
EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"


def events(spark, n=40):
    return spark.createDataFrame([(i, T + timedelta(minutes=37 * i), i % 3, "ab"[i % 2], float(i)) for i in range(n)], EVENTS)


def stream(spark, tmp_path, df):
    df.coalesce(2).write.parquet(str(tmp_path / "events.parquet"))
    return ledgers.event_stream(spark, str(tmp_path), "", df.schema, files=1)


def test_streams_settle_to_the_batch_result(spark, tmp_path):
    df = events(spark)
    s = stream(spark, tmp_path, df)
    for make in (lambda x: ledgers.tumbling(x, "ts", "6 hours", "event_type"), lambda x: ledgers.sliding(x, "ts", "2 hours", "1 hour", "event_type")):
        assert sorted(map(tuple, ledgers.settle(make(s)).collect())) == sorted(map(tuple, make(df).collect()))


def test_first_write_wins(spark, tmp_path):
    df = events(spark, 10).union(events(spark, 10))
    got = ledgers.settle(ledgers.first_writes(stream(spark, tmp_path, df), "event_id", "ts", "30 days"), "append")
    assert got.count() == 10


def test_sessions(spark):
    got = ledgers.sessions(events(spark, 4).withColumn("user_id", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1)), "ts", "38 minutes", "user_id").collect()
    assert [(r.n, r.end - r.start) for r in got] == [(4, timedelta(minutes=37 * 3 + 38))]


def test_regression_gate(spark):
    m = spark.createDataFrame([("1", 0, 5), ("2", 0, 4), ("3", 1, 4), ("4", 1, 4)], "k string, a int, b int")
    assert [r.regressed for r in ledgers.regression_gate(m, "k", ("a", "b")).orderBy("k").collect()] == [False, False, True, False]


def test_vault_and_ledger(spark, tmp_path):
    (tmp_path / "v" / "sub").mkdir(parents=True)
    (tmp_path / "v" / "a.md").write_text("---\nid: 1\n---\nbody\n")
    (tmp_path / "v" / "sub" / "b.md").write_text("no head")
    (tmp_path / "v" / "index.md").write_text("reserved")
    got = {r.name: (r["head"], r.body) for r in vault.read_notes(spark, str(tmp_path / "v")).collect()}
    assert got == {"a.md": ("id: 1", "body\n"), "b.md": (None, "no head")}
    (tmp_path / "l.jsonl").write_text('{"_comment": "x"}\n\n{"id": "a", "n": 1}\nbroken{\n{"id": "b"}\n')
    led = vault.read_ledger(spark, str(tmp_path / "l.jsonl"), "id string, n int")
    assert sorted(map(tuple, led.collect()), key=repr) == [("a", 1), ("b", None)]
    new = spark.createDataFrame([("a", 9), ("c", 2), ("c", 1), (None, 3)], "id string, n int")
    assert [tuple(r) for r in vault.append_new(led, new, "id").collect()] == [("c", 1)]
    vault.write_csv(vault.union_of_kinds(led, spark.createDataFrame([("z", ["p", "q"])], "id string, tags array<string>")), str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).where("id = 'z'").first().tags == "p;q"


def test_html():
    assert to_text("<nav>skip</nav><p>One &amp; two</p><script>x()</script><div>three<br>four</div>") == "One & two\nthree\nfour"
    assert to_text("<body>menu<article><p>body text</p></article></body>") == "body text"
    assert to_text('<article>a</article><script type="application/ld+json">{"@graph": [{"articleBody": "longer body"}]}</script>') == "longer body"
    assert to_text("") == ""


def test_addresses_and_bibliography(spark):
    html = """<head><link rel="canonical" href="/a?utm_source=x&q="><meta property="og:url" content="https://h.example/p?fbclid=1"><meta name="twitter:url" content="https://h.example/p">
    <meta name="citation_author" content="A B"><meta name="citation_author" content=" C "><meta name="dc.publisher" content="J"><meta name="dc.date" content="12 May 2021"><meta property="citation_doi" content="10.1/x"></head>"""
    assert candidate_urls(html, "https://h.example/p?gclid=2") == ["https://h.example/p", "https://h.example/a?q="]
    assert bibliography(html) == {"author": "A B, C", "journal": "J", "year": 2021, "doi": "10.1/x"}
    assert bibliography("<p>no head") == {"author": None, "journal": None, "year": None, "doi": None}
    df = spark.createDataFrame([(1, "https://h.example/p", html), (2, "https://h.example/q", None), (3, None, html)], "k int, url string, html string")
    got = {r.k: (r.candidates, r.author, r.year) for r in vault.html_facts(df, "k", "url", "html").collect()}
    assert got == {1: (["https://h.example/p", "https://h.example/a?q="], "A B, C", 2021), 2: (["https://h.example/q"], None, None)}


def test_lists_and_upserts(spark, tmp_path):
    (tmp_path / "in.txt").write_text("# head\n\n one \n#two\nthree\r\n")
    assert [r.item for r in vault.read_list(spark, str(tmp_path / "in.txt")).collect()] == ["one", "three"]
    vault.write_json(spark.createDataFrame([("a", None)], "id string, n int"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).columns == ["id", "n"]
    docs = spark.createDataFrame([(1, "---\ntags:\n- 'a b'\n- c\nother: x\n---\n- no"), (2, "---\ntags: [p, \"q\"]\n---\n"), (3, "tags:\n- no"), (4, None)], "doc_id bigint, text string")
    assert sorted(map(tuple, notes.front_list(docs, "tags").collect())) == [(1, 1, "a b"), (1, 2, "c"), (2, 1, "p"), (2, 2, "q")]
    (tmp_path / "e").mkdir()
    df = events(spark)
    got = ledgers.settle_upserts(stream(spark, tmp_path / "e", df), "user_id", "ts")
    assert {r.user_id: r.event_id for r in got.collect()} == {0: 39, 1: 37, 2: 38}
