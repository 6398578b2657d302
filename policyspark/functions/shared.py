"""Tables that a plan needs more than once, written to the folder all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which the context then writes to; where it is unset and all is one process, a folder of our own."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="policyspark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: made once, its lineage ended, safe from lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
