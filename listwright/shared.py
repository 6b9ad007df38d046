"""The folder that driver and executors share, and tables of a job in it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a default of our own only on one machine."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file:///tmp/checkpoints/listwright"


def fresh_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}/{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of ``path``, and the path as it wants it."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()), own


def delete(spark: SparkSession, path: str) -> None:
    fs, own = file_system(spark, path)
    fs.delete(own, True)


#: Rows of a table that one task sorts or joins where the number of tasks follows the table.
ROWS_A_TASK = 250_000


def tasks_for(df: DataFrame) -> int:
    """Tasks for work on ``df``, by its number of rows (of a file its footers tell them): a task's memory stays as it is when the table grows."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_A_TASK))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over four tasks a core, by ``keys`` or evenly; partitions of a stated number are not put together again for being small in bytes."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)
