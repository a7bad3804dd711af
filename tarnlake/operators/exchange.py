"""Partitioning by key, and partitions kept in files."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scope import quoted

PARTITION = "_partition_"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it. Where none is named, a local master
    gets a folder that is deleted at exit; on a cluster that is an error."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="tarnlake-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def partition(frame: DataFrame, key: str, n: int) -> DataFrame:
    """Rows dealt out by a hash of the key to n >= 1 partitions; the partition's number is a further column."""
    spread = frame.repartition(max(1, n), F.col(quoted(key)))
    return spread.withColumn(PARTITION, F.spark_partition_id())


def materialize(parts: DataFrame) -> DataFrame:
    """All partitions as one table again."""
    return parts.drop(PARTITION)


def checkpoint(parts: DataFrame, path: str) -> None:
    """Write partitions, one folder each."""
    parts.write.mode("overwrite").partitionBy(PARTITION).parquet(path)


def restore(spark: SparkSession, path: str) -> DataFrame:
    """Read them again, each with its number."""
    return spark.read.parquet(path)
