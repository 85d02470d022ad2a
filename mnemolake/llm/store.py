"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import gc
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Whether a query's shuffle files go at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


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


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder as rows."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


@contextmanager
def freeing(spark: SparkSession):
    """Shuffle files of the queries run within go at each query's end, not when the driver next collects its garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` computed once and kept in the shared folder as Parquet, for large tables.

    Shuffle files that served only to make it go as soon as it stands: what comes after reads the table.
    """
    spark = df.sparkSession
    path = path or f"{shared_folder(spark)}/{uuid.uuid4().hex}.parquet"
    with freeing(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables of one query, deleted when it no longer reads them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.tables = spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}", []

    def written(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{len(self.tables)}.parquet"
        self.tables.append(written(df, path))
        return self.tables[-1]

    def drop(self, table: DataFrame | None = None) -> None:
        """Delete one table, or all."""
        place = "" if table is None else f"/{next(k for k, t in enumerate(self.tables) if t is table)}.parquet"
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder + place)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        # plans and broadcasts of what read it are held until both sides collect their garbage, which may come late in a driver
        gc.collect()
        self.spark._jvm.System.gc()
