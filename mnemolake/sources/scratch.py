"""Results of a step kept in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder: that of ``spark.checkpoint.dir``.

    Where it is unset, a local session gets one beside its warehouse; a cluster has to name one.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "_checkpoints"
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def new_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared one."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once, without lineage, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
