import json

from ledgerloom.operators import nested
from pyspark.sql import functions as F

SCHEMA = "claim_id string, source_ids array<string>, source_anchors array<struct<" + ",".join(f"`{f}`:{t}" for f, t in nested.ANCHOR.items()) + ",spans:array<struct<start_char:bigint,end_char:bigint,labels:array<string>>>>>, item_no string"


def anchor(*spans, **k):
    return {"source_id": k.get("source_id"), "anchor": k.get("anchor"), "page": None, "section": None, "path": None, "line_start": None, "line_end": None, "spans": list(spans) if spans or k.get("empty") else None}


def span(a, b, labels=None):
    return {"start_char": a, "end_char": b, "labels": labels}


def claims(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def test_nodes_are_numbered_depth_first(spark):
    df = claims(spark, [("c", ["s1", None, "s3"], [anchor(span(1, 2, ["x", "y"]), None, span(3, 4)), None, anchor()])])
    nodes = {(r.kind, r.pre): (r.post, r.place) for r in nested.label_nodes(nested.typed_shape(df)).collect()}
    assert nodes == {
        ("claim", 1): (9, 1), ("source_id", 2): (1, 1), ("source_id", 3): (2, 3), ("anchor", 4): (7, 1), ("span", 5): (5, 1),
        ("label", 6): (3, 1), ("label", 7): (4, 2), ("span", 8): (6, 3), ("anchor", 9): (8, 3),
    }


def test_intervals_contain_exactly_the_descendants(spark):
    df = claims(spark, [(f"c{i}", ["s"] * (i % 4), [anchor(*[span(k, k, ["l"] * (k % 3)) for k in range(i % 5)], empty=True) for _ in range(i % 3)]) for i in range(30)])
    nodes = nested.label_nodes(nested.typed_shape(df)).collect()
    for r in {n.claim_id for n in nodes}:
        own = sorted((n for n in nodes if n.claim_id == r), key=lambda n: n.pre)
        assert [n.pre for n in own] == list(range(1, len(own) + 1))
        assert sorted(n.post for n in own) == list(range(1, len(own) + 1))
        depth = {"claim": 0, "source_id": 1, "anchor": 1, "span": 2, "label": 3}
        for n in own:
            above = [m for m in own if m.pre < n.pre and m.post > n.post]
            assert len(above) == depth[n.kind]


def test_children_name_parent_and_place(spark):
    df = claims(spark, [("c", ["", None], [None, anchor(span(None, None), None, span(1, 2))]), ("c", ["", None], [None, anchor(span(None, None), None, span(1, 2))]), (None, ["x"], None), ("n", None, []), ("e", [], None)])
    got = sorted(tuple(r) for r in nested.child_elements(nested.typed_shape(df)).collect())
    assert got == [("c", "anchor", 2, 0), ("c", "source_id", 1, 0), ("c", "span", 2, 1), ("c", "span", 2, 3)]


def test_feed_shapes(spark):
    payloads = [
        json.dumps({"claim_id": "a", "source_ids": ["s", None, ""], "source_anchors": {"spans": {"start_char": 1}}}),
        json.dumps({"exported_by": "x", "record": {"evidence": {"source_ids": "s", "source_anchors": [{}, None, {"spans": [None, {}]}]}, "claim_id": "b"}}),
        '{"claim_id": "bad", "source_ids": ["s"', None, "null", "[]", "3", json.dumps({"claim_id": None, "source_ids": ["s"]}), json.dumps({"claim_id": "z", "source_ids": None, "evidence": None}),
    ]
    feed = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "feed_id bigint, payload string")
    got = sorted(tuple(r) for r in nested.child_elements(nested.feed_shape(feed)).collect())
    assert got == [("a", "anchor", 1, 0), ("a", "source_id", 1, 0), ("a", "source_id", 3, 0), ("a", "span", 1, 1), ("b", "anchor", 1, 0), ("b", "anchor", 3, 0), ("b", "source_id", 1, 0), ("b", "span", 3, 2)]


def test_empty_tables(spark):
    assert nested.child_elements(nested.typed_shape(claims(spark, []))).count() == 0
    assert nested.child_elements(nested.feed_shape(spark.createDataFrame([], "payload string"))).count() == 0


def test_very_long_record(spark):
    df = claims(spark, [("c", ["s"] * 20000, [anchor(*[span(1, 2, ["l"])] * 3) for _ in range(3000)])])
    assert nested.child_elements(nested.typed_shape(df)).groupBy("child").count().orderBy("child").collect() == [("anchor", 3000), ("source_id", 20000), ("span", 9000)]


def test_flat_tables(spark):
    df = claims(spark, [("c", ["", None, "s"], [anchor(span(1, 2, ["x", None, "y"]), source_id="s"), None, anchor(None, span(3, 4), source_id="t")])] * 2)
    feed = spark.createDataFrame([(json.dumps({"record": {"claim_id": "f", "evidence": {"source_ids": "one", "source_anchors": {"quote": "q", "page": 7, "line_start": "nine", "spans": {"start_char": 5, "labels": "x"}}}}}),), (None,), ("{",)], "payload string")
    records = nested.typed_records(df).unionByName(nested.feed_records(feed))
    sort = lambda t: sorted(map(tuple, t.collect()), key=repr)
    assert sort(nested.source_table(records)) == [("c", 1, ""), ("c", 3, "s"), ("f", 1, "one")]
    a = {(r.claim_id, r.item_no): r for r in nested.anchor_table(records).collect()}
    assert {k: (r.source_id, r.page, r.quote, r.line_start) for k, r in a.items()} == {("c", 1): ("s", None, None, None), ("c", 3): ("t", None, None, None), ("f", 1): (None, 7, "q", None)}
    assert sort(nested.span_table(records)) == [("c", 1, 1, 1, 2, 2), ("c", 3, 2, 3, 4, 0), ("f", 1, 1, 5, None, 1)]
    assert sort(nested.label_table(records)) == [("c", 1, 1, 1, "x"), ("c", 1, 1, 3, "y"), ("f", 1, 1, 1, "x")]
    assert sort(nested.label_counts(records)) == [("x", 2, 2), ("y", 1, 1)]
    # An interval holds another exactly if its node is an ancestor: a claim holds all its nodes.
    n = nested.node_table(records)
    claim = n.where("kind = 'claim'").select("claim_id", "rec", F.col("pre").alias("p"), F.col("post").alias("q"))
    assert n.where("kind <> 'claim'").join(claim, ["claim_id", "rec"]).where("pre > p AND post < q").count() == n.where("kind <> 'claim'").count() == 12
    assert nested.anchor_table(records.limit(0)).count() == 0
