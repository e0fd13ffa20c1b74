"""Joins whose sides are repeated or made many rows of are not sent to the driver, however small the planner takes them for."""

from __future__ import annotations

from ledgerloom.llm import crosssplit


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def stored(spark, path, rows):
    """A table in a file, whose size the planner knows."""
    spark.createDataFrame(rows, "id string, question string").write.parquet(str(path))
    return spark.read.parquet(str(path))


def test_overlaps_broadcast_nothing(spark, tmp_path):
    train = stored(spark, tmp_path / "train", [("t1", "what is the limit of the broker queue"), ("t2", "broker queue limit, what is it 7"), (None, "x")])
    evaluation = stored(spark, tmp_path / "evaluation", [("e1", "What is the limit of the broker's queue?"), ("e2", None)])
    found = crosssplit.overlaps(train, evaluation)
    assert "Join" in plan(found) and "Broadcast" not in plan(found)
    assert [tuple(r) for r in found.collect()] == [("t1", "e1")]
