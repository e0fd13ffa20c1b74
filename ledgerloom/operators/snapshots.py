"""What changed between consecutive full snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.keys import folded


def latest_state(state: DataFrame, snapshot: str, key: str, version: str, compared: Sequence[tuple[str, Column]]) -> DataFrame:
    """One row per snapshot and key: the one of the latest ``version``; of equal versions the greatest values."""
    newest = F.max(F.struct(F.col(version).alias("v"), *(c.alias(n) for n, c in compared)))
    return state.where(F.col(snapshot).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(snapshot).alias("snapshot"), F.col(key).alias("id")).agg(newest.alias("row")).select("snapshot", "id", *(f"row.{n}" for n, _ in compared))


def successors(snapshots: DataFrame) -> DataFrame:
    """``snapshot``, ``after`` (the next name or null) and ``first``: one row per snapshot, in order of their names."""
    order = Window.partitionBy(F.lit(0)).orderBy("snapshot")
    return snapshots.where("snapshot IS NOT NULL").distinct().select("snapshot", F.lead("snapshot").over(order).alias("after"), (F.row_number().over(order) == 1).alias("first"))


def snapshot_changes(state: DataFrame, snapshots: DataFrame | None = None, snapshot: str = "snapshot", key: str = "id", version: str = "delivered_at", compared: Sequence[str] = ("content_hash", "source_status")) -> DataFrame:
    """``(snapshot, id, change)``: records added, removed or changed against the snapshot before.

    ``state`` lists all records of each snapshot; of several rows for a snapshot and key the latest
    ``version`` holds. ``snapshots`` may name snapshots that have no rows, which then remove everything.
    Compared columns are equal if they are so without outer blanks and letter case; null equals null only.

    EXCEPT ALL both ways is one signed multiset sum: a row counts +1 in its own snapshot and -1 in the
    next; identical rows cancel (map side first), positive residues are new rows and negative ones old
    rows. The residues of a key, at most one of each sign, are then joined in full.

    Rows without snapshot or key name no record and are left out; repeated rows count once; an empty
    table gives no rows; other columns are never read.
    """
    named = state.select(F.col(snapshot).alias("snapshot"))
    order = successors(named.union(snapshots.select(snapshot)) if snapshots is not None else named)
    rows = latest_state(state, snapshot, key, version, [(f"c{i}", folded(F.col(c))) for i, c in enumerate(compared)])
    values = [f"c{i}" for i in range(len(compared))]
    sides = F.filter(F.array(F.struct(F.when(~F.col("first"), F.col("snapshot")).alias("at"), F.lit(1).alias("sign")), F.struct(F.col("after").alias("at"), F.lit(-1).alias("sign"))), lambda x: x["at"].isNotNull())
    signed = rows.join(order, "snapshot").select(F.explode(sides).alias("side"), "id", *values)
    net = signed.groupBy(F.col("side.at").alias("snapshot"), "id", *values).agg(F.sum("side.sign").alias("n")).where("n <> 0")
    new, old = net.where("n > 0").select("snapshot", "id", F.lit(True).alias("new")), net.where("n < 0").select("snapshot", "id", F.lit(True).alias("old"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return new.join(old, ["snapshot", "id"], "full").select("snapshot", "id", change.alias("change"))


def change_counts(changes: DataFrame) -> DataFrame:
    """Rows of ``snapshot_changes`` per snapshot and kind of change."""
    return changes.groupBy("snapshot", "change").agg(F.count(F.lit(1)).alias("n"))
