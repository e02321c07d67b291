"""Cutting lineage: intermediate rows in the shared checkpoint folder, so that a lost executor costs no more than its own tasks."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the cluster names; one of this machine only where Spark itself runs in one process."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="prosegauge-checkpoints-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and read from the checkpoint folder from here on."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()
