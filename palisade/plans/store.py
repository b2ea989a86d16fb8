"""Cutting lineage: keep a small intermediate table instead of computing it again."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``; a local one only if unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    folder = tempfile.mkdtemp(prefix="palisade-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialise(frame: DataFrame) -> DataFrame:
    """Reliable checkpoint; used for findings, which are tiny next to the texts."""
    spark = frame.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return frame.checkpoint(eager=True)
