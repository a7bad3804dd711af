"""Tables in files, in any store that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The tables of the test data.
NAMES = tuple("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())


def parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
