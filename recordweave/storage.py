"""Intermediate tables in storage that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; only a local master may leave that unset and gets a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="recordweave-"))
    return context.getCheckpointDir()


def materialised(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, its lineage cut; a lost executor loses nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
