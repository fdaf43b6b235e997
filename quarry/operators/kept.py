"""Tables that are computed once and kept in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; a temporary folder of this machine only where that is unset and the master is local."""
    sc = spark.sparkContext
    set_up = sc._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or (None if set_up.isEmpty() else set_up.get())
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the driver and the executors share")
        named = tempfile.mkdtemp(prefix="quarry-kept-")
    if set_up.isEmpty():
        sc.setCheckpointDir(named)
    return named


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once, its lineage cut: lost executors cost their own tasks only."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
