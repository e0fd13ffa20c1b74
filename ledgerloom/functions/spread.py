"""Spreading scans that are too few for the cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if its plan has at most half as many partitions, else as it is.

    Meant for a pruned scan before costly work a row: one small file is one task otherwise. A scan of many
    files, as large tables are, is never moved. Only planning is needed to tell.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df
