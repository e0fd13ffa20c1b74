"""References to records that are missing, deleted or arrive later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.keys import day_of, folded, source_key
from ledgerloom.functions.skew import salted_join

#: Fixed value: the status of a record that its origin no longer holds.
DELETED = "deleted-from-origin"


def references(table: DataFrame, name: str, record: str, keys: str, day: str) -> DataFrame:
    """``(table_name, record_id, source_id, day)``: each id in the array column ``keys``, once per record.

    Null and empty arrays, null or empty elements and elements without an id give no row, as do rows
    without a record id.
    """
    plain = F.array_distinct(F.transform(F.col(keys), source_key))
    return table.where(F.col(record).isNotNull()).select(F.lit(name).alias("table_name"), F.col(record).alias("record_id"), F.explode(plain).alias("source_id"), day_of(F.col(day)).alias("day")).where("source_id IS NOT NULL")


def parents(registry: DataFrame) -> DataFrame:
    """Long form of the parent keys: ``(source_id, first_day, status)`` of every registry row."""
    return registry.where("id IS NOT NULL").select(F.coalesce(source_key(F.col("id")), F.col("id")).alias("source_id"), day_of(F.col("ingested_at")).alias("first_day"), F.struct("loaded_at", folded(F.col("source_status")).alias("status")).alias("latest"))


def key_verdicts(children: DataFrame, registry: DataFrame) -> DataFrame:
    """``(source_id, missing, deleted, first_day)`` of each referred key that may be a case.

    Parent rows and, per key, the earliest and latest day of a reference (pre-aggregated) are united in
    long form and grouped by key: no parent row means missing, the latest loaded row says deleted, and
    a first day is kept where some reference is earlier. All other keys are dropped here, before any join.
    """
    child = children.groupBy("source_id").agg(F.min("day").alias("child_day")).select("source_id", F.lit(1).alias("child"), F.col("child_day"), F.lit(0).alias("parent"), F.lit(None).cast("date").alias("first_day"), F.lit(None).cast("struct<loaded_at:timestamp,status:string>").alias("latest"))
    parent = parents(registry).select("source_id", F.lit(0).alias("child"), F.lit(None).cast("date").alias("child_day"), F.lit(1).alias("parent"), "first_day", F.col("latest").cast("struct<loaded_at:timestamp,status:string>").alias("latest"))
    grouped = child.unionByName(parent).groupBy("source_id").agg(F.max("child").alias("child"), F.max("parent").alias("parent"), F.min("child_day").alias("child_day"), F.min("first_day").alias("first_day"), F.max("latest").alias("latest"))
    missing, deleted = F.col("parent") == 0, F.coalesce(F.col("latest.status") == DELETED, F.lit(False))
    late = F.coalesce(F.col("first_day") > F.col("child_day"), F.lit(False))
    return grouped.where((F.col("child") == 1) & (missing | deleted | late)).select("source_id", missing.alias("missing"), deleted.alias("deleted"), "first_day")


def _reason(day: Column) -> Column:
    return F.when(F.col("missing"), "missing").when(F.col("deleted"), "deleted").when(F.col("first_day") > day, "late")


def orphan_references(children: DataFrame, registry: DataFrame) -> DataFrame:
    """``(table_name, record_id, source_id, day, reason)`` of the references that are a case, repeated rows once.

    reason is ``missing`` (no registry row has the id), ``deleted`` or ``late`` (first ingested on a later
    day than the record's). Unknown days are never later. A key that a third of all references name is
    split over the salts of the join.
    """
    hit = salted_join(children, key_verdicts(children, registry), ["source_id"], ["record_id"])
    return hit.withColumn("reason", _reason(F.col("day"))).where("reason IS NOT NULL").select("table_name", "record_id", "source_id", "day", "reason").distinct()


def orphan_counts(children: DataFrame, registry: DataFrame) -> DataFrame:
    """``(table_name, period, reason, n_references, n_sources)``: cases per table and month (``unknown`` without a day).

    Children are counted per key and day before they meet the verdicts, so no group of references of a
    key is ever moved; a record that is delivered twice counts once.
    """
    counted = children.distinct().groupBy("table_name", "source_id", "day").agg(F.count(F.lit(1)).alias("n"))
    hit = counted.join(key_verdicts(children, registry), "source_id").withColumn("reason", _reason(F.col("day"))).where("reason IS NOT NULL")
    period = F.coalesce(F.date_format("day", "yyyy-MM"), F.lit("unknown"))
    return hit.groupBy("table_name", period.alias("period"), "reason").agg(F.sum("n").alias("n_references"), F.countDistinct("source_id").alias("n_sources"))
