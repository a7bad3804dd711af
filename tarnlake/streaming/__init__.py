"""The dialect over streams: queries are DataFrames, so they run on streaming tables as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def follow(spark: SparkSession, path: str, schema: T.StructType, files_each: int | None = None) -> DataFrame:
    """A table that grows with the Parquet files of a folder."""
    reader = spark.readStream.schema(schema)
    if files_each:
        reader = reader.option("maxFilesPerTrigger", files_each)
    return reader.parquet(path)


def start(result: DataFrame, name: str, checkpoint: str, complete: bool = False) -> StreamingQuery:
    """Keep a result up to date in an in-memory table. complete: for aggregates, whose rows change."""
    mode = "complete" if complete else "append"
    return result.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
