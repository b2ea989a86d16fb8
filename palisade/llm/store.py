"""Tables kept between jobs, in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of our own only where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="palisade-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def saved(frame: DataFrame) -> DataFrame:
    """Write the rows once as Parquet and read them back: lineage ends here.

    A lost executor costs only the tasks that were running; finished files stay, until ``release``
    or the cluster's own clean-up of the folder.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/palisade-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def text_key() -> Column:
    """Hash of the text: with the id it tells rows apart, also where ids are null or repeat."""
    return F.xxhash64("text")


def private(*names: str) -> list[str]:
    """Column names that no table has, for what is joined to tables of any columns."""
    mark = uuid.uuid4().hex
    return [f"__{mark}_{name}" for name in names]


def release(*tables: DataFrame) -> None:
    """Delete ``saved`` tables that nothing reads any more, and the shuffles that made them.

    Spark drops a shuffle's files once the driver has collected its plan, so a collection is asked for.
    """
    for table in tables:
        spark = table.sparkSession
        for file in table.inputFiles()[:1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    gc.collect()
    SparkSession.active()._jvm.System.gc()
