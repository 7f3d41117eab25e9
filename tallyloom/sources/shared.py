"""The folder that driver and executors share, and small tables in it."""

from __future__ import annotations

import tempfile

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, where executors find what others wrote.

    A session on one machine that has none is given a temporary folder; on a
    cluster that would be another folder on every machine, so there a missing
    setting raises ``ValueError``.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="shared-"))
    return context.getCheckpointDir()


def stored(frame: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def parquet_or_none(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A Parquet table; None if nothing is at the path."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
