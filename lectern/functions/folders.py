"""The folder that driver and executors share, and tables whose lineage is cut there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one where it is unset."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", "") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="lectern-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return where


def checkpoint(df: DataFrame) -> DataFrame:
    """df with its lineage cut, its rows in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
