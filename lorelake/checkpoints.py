"""Lineage cuts on the shared folder named by the session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ready(spark: SparkSession) -> None:
    """Use ``spark.checkpoint.dir``; only in one process (tests), where it is unset, make a folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="run-"))


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder and continue from there."""
    ready(df.sparkSession)
    return df.checkpoint(eager=True)


def folder(spark: SparkSession) -> str:
    """A new folder name inside the shared checkpoint folder."""
    ready(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4()}"


def stored(df: DataFrame) -> DataFrame:
    """Write the rows as compressed Parquet to a new folder and continue from there: less disk than ``cut`` for rows that repeat values."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
