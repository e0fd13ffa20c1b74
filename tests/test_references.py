from datetime import date, datetime

from ledgerloom.functions.keys import day_of, source_key
from ledgerloom.operators import references
from pyspark.sql import functions as F

REG = "id string, source_status string, ingested_at string, loaded_at timestamp, day string"
T = datetime(2026, 1, 1)


def test_keys_in_every_spelling(spark):
    forms = ["src-0a1b2c3d4e", " src-0A1B2C3D4E ", "[[Sources/src-0a1b2c3d4e|src-0a1b2c3d4e]]", "Sources/src-0a1b2c3d4e", "0a1b2c3d4e", "src-0a1b2c3d4e#page=64"]
    df = spark.createDataFrame([(f,) for f in [*forms, None, "", "x", "0a1b2c3d4e5f"]], "x string").select(source_key(F.col("x")).alias("k"))
    assert [r.k for r in df.collect()] == ["src-0a1b2c3d4e"] * 6 + [None] * 4


def test_days(spark):
    df = spark.createDataFrame([(x,) for x in ["2025-03-04", " 2025-03-04T23:59:59Z", "20250304-101112", "2025-13-40", None, "", "soon"]], "x string").select(day_of(F.col("x")).alias("d"))
    assert [r.d for r in df.collect()] == [date(2025, 3, 4)] * 3 + [None] * 4


def found(spark, claims, registry):
    c = spark.createDataFrame([(*r, "clash") for r in claims], "claim_id string, source_ids array<string>, last_updated string, source_id string")
    children = references.references(c, "claims", "claim_id", "source_ids", "last_updated")
    reg = spark.createDataFrame([(*r, "clash") for r in registry], REG)
    return children, reg


def test_reasons(spark):
    ids = [f"src-{i:010x}" for i in range(6)]
    claims = [("c1", ids, "2025-05-05"), ("c1", ids, "2025-05-05"), ("c2", [ids[1], None, "", "bare"], None), ("c3", None, "2025-05-05"), (None, ids, "2025-05-05")]
    registry = [(ids[0], "active", "2025-05-05", T), (ids[1], "deleted-from-origin", "2025-01-01", T), (ids[2], "active", "20250506-000000", T), (ids[2], "active", "2025-05-07", T), (ids[3], "active", None, T), (ids[4], "permission-revoked", "2025-05-06", T), (ids[4], "permission-revoked", "2025-05-01", T)]
    children, reg = found(spark, claims, registry)
    got = sorted((r.record_id, r.source_id, r.reason) for r in references.orphan_references(children, reg).collect())
    assert got == [("c1", ids[1], "deleted"), ("c1", ids[2], "late"), ("c1", ids[5], "missing"), ("c2", ids[1], "deleted")]
    counts = {(r.period, r.reason): (r.n_references, r.n_sources) for r in references.orphan_counts(children, reg).collect()}
    assert counts == {("2025-05", "deleted"): (1, 1), ("2025-05", "late"): (1, 1), ("2025-05", "missing"): (1, 1), ("unknown", "deleted"): (1, 1)}


def test_empty_tables(spark):
    children, reg = found(spark, [], [])
    assert references.orphan_references(children, reg).count() == 0
    children, reg = found(spark, [("c", ["src-00000000aa"], None)], [])
    assert [r.reason for r in references.orphan_references(children, reg).collect()] == ["missing"]


def test_hot_key_is_whole(spark):
    children, reg = found(spark, [(f"c{i}", ["0000000001"], "2025-01-01") for i in range(2000)], [("src-0000000001", "deleted-from-origin", "2024-01-01", T)])
    assert references.orphan_references(children, reg).count() == 2000
