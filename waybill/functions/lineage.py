"""Cutting lineage with a written table in the folder that the session names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.  Where the setting is absent, a local session (tests) gets a temporary one; a cluster must name one."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="waybill-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def cut(rows: DataFrame) -> DataFrame:
    """``rows`` written once as a reliable checkpoint, for rows that several branches read."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint(eager=True)
