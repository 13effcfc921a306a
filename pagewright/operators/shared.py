"""The folder that driver and executors share, and tables whose lineage is cut there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def set_folder(spark: SparkSession) -> None:
    """Sets the folder for checkpoints to what spark.checkpoint.dir names; one of our own only in local mode, where none is set."""
    if spark.sparkContext.getCheckpointDir():
        return
    at = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not at and not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(at or tempfile.mkdtemp(prefix="pagewright-"))


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the shared folder, made now."""
    set_folder(df.sparkSession)
    return df.checkpoint(eager=True)
