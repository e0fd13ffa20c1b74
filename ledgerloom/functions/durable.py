"""Cutting lineage so that a job survives the loss of executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; a local one is set only where none is configured and the session is local (tests).

    A cluster's executors share no local folder, so a session on one without ``spark.checkpoint.dir`` is refused.
    """
    sc = spark.sparkContext
    held = sc.getCheckpointDir()
    if held:
        return held
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="ledgerloom-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_checkpoint(df: DataFrame) -> DataFrame:
    """The same for loops of many rounds, without what the optimizer inferred about the rows.

    A checkpoint keeps the constraints of the plan it was made by; where each round joins the one before with
    itself, they double from round to round until planning takes longer than the work.
    """
    kept, spark = checkpoint(df), df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept._jdf.queryExecution().toRdd(), kept._jdf.schema(), False), spark)
