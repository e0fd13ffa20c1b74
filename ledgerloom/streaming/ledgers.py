"""Append-only ledgers, windowed counters and a regression gate as streams.

Each transformation is an ordinary DataFrame function that works on a stream and on a table alike.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.functions.durable import checkpoint_dir


def event_stream(spark: SparkSession, folder: str, name: str, schema: StructType, files: int = 4) -> DataFrame:
    """A stream over the parquet files ``name*.parquet`` of a folder, ``files`` at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", f"{name}*.parquet").option("recursiveFileLookup", "true").parquet(folder)


def first_writes(events: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """First-write-wins by ``key``: repeats within the watermark are dropped, with state bounded by it."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def tumbling(events: DataFrame, at: str, width: str, by: str, late: str = "1 hour") -> DataFrame:
    """``(start, by, n, total)`` per tumbling window; rows later than the watermark are dropped from streams."""
    w = events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), F.col(by)).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return w.select(F.col("w.start").alias("start"), by, "n", "total")


def sliding(events: DataFrame, at: str, width: str, slide: str, by: str, late: str = "1 hour") -> DataFrame:
    """``(start, by, n)`` per sliding window."""
    w = events.withWatermark(at, late).groupBy(F.window(at, width, slide).alias("w"), F.col(by)).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("start"), by, "n")


def sessions(events: DataFrame, at: str, gap: str, by: str, late: str = "1 hour") -> DataFrame:
    """``(by, start, end, n)``: sessions of a key that no gap longer than ``gap`` interrupts; ``end`` is the last event plus the gap."""
    w = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), F.col(by)).agg(F.count(F.lit(1)).alias("n"))
    return w.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def settle(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is available now; its result, kept as a table in the shared checkpoint folder.

    In complete mode each batch replaces the table (the last one holds); in append mode batches are
    numbered folders, so a batch that is run again after a failure replaces itself.
    """
    spark = stream.sparkSession
    home = os.path.join(checkpoint_dir(spark), f"stream-{uuid.uuid4().hex}")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/rows" if mode == "complete" else f"{home}/rows/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{home}/state").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{home}/rows")


def settle_upserts(stream: DataFrame, key: str, version: str) -> DataFrame:
    """The row of the greatest ``version`` per key of all that is available now, merged batch by batch.

    Batch n merges its own latest rows with the table that batch n - 1 left and writes a new one, so a batch
    that is run again writes the same table. Null keys are left out; ties go to the greater other columns.
    """
    spark = stream.sparkSession
    home = os.path.join(checkpoint_dir(spark), f"upserts-{uuid.uuid4().hex}")
    last: list[int] = []

    def latest(rows: DataFrame) -> DataFrame:
        rest = [c for c in stream.columns if c not in (key, version)]
        best = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(version, *rest)).alias("r"))
        return best.select(*(F.col(key) if c == key else F.col(f"r.{c}") for c in stream.columns))

    def merge(batch: DataFrame, number: int) -> None:
        rows = latest(batch)
        if number:
            rows = latest(rows.unionByName(spark.read.schema(stream.schema).parquet(f"{home}/rows-{number - 1}")))
        rows.write.mode("overwrite").parquet(f"{home}/rows-{number}")
        last[:] = [number]

    stream.writeStream.option("checkpointLocation", f"{home}/state").foreachBatch(merge).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{home}/rows-{last[0]}") if last else spark.createDataFrame([], stream.schema)


def regression_gate(metrics: DataFrame, key: str, hard: tuple[str, ...]) -> DataFrame:
    """``metrics`` with ``regressed``: whether any hard counter rose strictly against the row before; the first never regresses."""
    order = Window.partitionBy(F.lit(0)).orderBy(key)
    worse = [F.coalesce(F.col(c) > F.lag(c).over(order), F.lit(False)) for c in hard]
    out = worse[0]
    for x in worse[1:]:
        out = out | x
    return metrics.select("*", out.alias("regressed"))
