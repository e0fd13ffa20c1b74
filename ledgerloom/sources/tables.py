"""The tables of a data folder."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``folder/name.parquet``; columns and filters of later steps reach the scan."""
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))
