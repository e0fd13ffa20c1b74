import random
from datetime import datetime, timedelta

from ledgerloom.operators import snapshots

SCHEMA = "snapshot string, id string, content_hash string, source_status string, tier string, delivered_at timestamp, change string"
T = datetime(2026, 1, 1)


def state(spark, rows):
    return spark.createDataFrame([(*r[:4], "t", T + timedelta(hours=r[4] if len(r) > 4 else 0), "clash") for r in rows], SCHEMA)


def changes(spark, rows, names=None):
    log = spark.createDataFrame([(n,) for n in names], "snapshot string") if names else None
    return sorted(tuple(r) for r in snapshots.snapshot_changes(state(spark, rows), log).collect())


def test_kinds_of_change(spark):
    rows = [("a", "1", "h", "active"), ("a", "2", "h", "active"), ("a", "3", None, "active"), ("a", "4", "h", None), ("b", "1", " H ", "ACTIVE"), ("b", "3", "h", "active"), ("b", "4", "h", None), ("b", "5", None, None), ("b", "5", None, None)]
    assert changes(spark, rows) == [("b", "2", "removed"), ("b", "3", "changed"), ("b", "5", "added")]


def test_latest_delivery_holds(spark):
    rows = [("a", "1", "x", "active", 1), ("a", "1", "y", "active", 2), ("b", "1", "y", "active", 0)]
    assert changes(spark, rows) == []


def test_a_snapshot_without_rows_removes_all_and_its_successor_adds(spark):
    rows = [("a", "1", "h", "s"), ("c", "1", "h", "s")]
    assert changes(spark, rows, ["a", "b", "c", None]) == [("b", "1", "removed"), ("c", "1", "added")]


def test_nulls_and_empty(spark):
    assert changes(spark, []) == []
    assert changes(spark, [(None, "1", "h", "s"), ("a", None, "h", "s"), ("b", "1", "h", "s")]) == [("b", "1", "added")]


def test_against_brute_force(spark):
    r = random.Random(3)
    rows = [(s, str(r.randrange(12)), r.choice(["h", "H ", "g", None]), r.choice(["active", " Active", "stale"]), r.randrange(5)) for s in "abcd" for _ in range(30)]
    norm = lambda x: x if x is None else x.strip().lower()
    at = {}
    for s, i, h, st, t in rows:
        v = (t, norm(h) or "", norm(st))
        at[s, i] = max(at.get((s, i), v), v)
    want = []
    for p, q in zip("abc", "bcd"):
        for i in map(str, range(12)):
            x, y = at.get((p, i)), at.get((q, i))
            if x or y:
                kind = "added" if not x else "removed" if not y else "changed" if x[1:] != y[1:] else None
                if kind:
                    want.append((q, i, kind))
    assert changes(spark, rows) == sorted(want)
