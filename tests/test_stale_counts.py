"""Counts of stale targets equal those of the listed ones, and a concept's answers are not listed for every change."""

from __future__ import annotations

from ledgerloom.operators import upkeep
from pyspark.sql import functions as F

EDGES = [("source", "s1", "claim", "c1"), ("source", "s2", "claim", "c1"), ("source", "s2", "claim", "c2"), ("source", "s2", "claim", "c3"), ("claim", "c1", "concept", "k1"), ("claim", "c2", "concept", "k1"), ("claim", "c2", "concept", "k2"), ("concept", "k1", "answer", "1"), ("concept", "k1", "answer", "12"), ("concept", "k2", "answer", "2"), ("concept", "k2", "answer", "12"), ("concept", "k2", "answer", "2"), ("concept", "k3", "answer", "9")]


def test_counts_equal_the_listed_targets(spark):
    e = spark.createDataFrame(EDGES, "from_type string, a string, to_type string, b string")
    changed = spark.createDataFrame([("v1", "s1"), ("v1", "s2"), ("v2", "s2"), ("v2", "gone"), (None, "s1"), ("v3", None), ("v1", "s1")], "version string, source_id string")
    listed = upkeep.stale_targets(changed, e).groupBy("version", "source_id", "target_type").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("first"))
    counted = upkeep.stale_counts(changed, e)
    assert counted.columns == listed.columns and sorted(map(tuple, counted.collect())) == sorted(map(tuple, listed.collect()))
    assert ("v1", "s2", "answer", 3, "1") in map(tuple, counted.collect()) and upkeep.stale_counts(changed, e.limit(0)).count() == 0


def test_answers_are_not_listed_for_every_change(spark, monkeypatch):
    seen, plain = [], upkeep.stale_targets
    monkeypatch.setattr(upkeep, "stale_targets", lambda c, e: seen.append(plain(c, e)) or seen[-1])
    many = [("concept", "k1", "answer", str(i)) for i in range(100, 300)]
    changed = spark.createDataFrame([("v1", "s1"), ("v1", "s2")], "version string, source_id string")
    got = {(r.source_id, r.target_type): r.n for r in upkeep.stale_counts(changed, spark.createDataFrame(EDGES + many, "from_type string, a string, to_type string, b string")).collect()}
    assert got["s1", "answer"] == 202 and got["s2", "answer"] == 203 and seen[0].count() < 20
