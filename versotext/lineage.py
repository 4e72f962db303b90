"""Cutting lineage where a result is used several times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def settled(df: DataFrame) -> DataFrame:
    """The rows, computed once and read back from the shared checkpoint folder.

    The folder is the cluster's ``spark.checkpoint.dir``; only in a local session without it, as in tests,
    a folder under the warehouse is used, and any other session fails. The copy is a reliable one: lost executors don't lose it.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder of reliable checkpoints, set where it wasn't."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return named or context.getCheckpointDir()
