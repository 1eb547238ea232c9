"""Structured Streaming: files as a stream into a table of the last row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docengine.operators.shapes import latest
from docengine.session import scratch_folder


def file_stream(spark: SparkSession, path: str, schema: StructType, max_files: int = 16) -> DataFrame:
    """Parquet files that arrive under a path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def append_batches(stream: DataFrame, path: str, state: str):
    """Write each batch once under its number; a batch that is retried replaces itself."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()


def stream_latest(spark: SparkSession, path: str, schema: StructType, key: Sequence[str], version: str) -> DataFrame:
    """Read a folder or file to its end as a stream, and give the last row of each key."""
    folder = scratch_folder(spark, "stream")
    append_batches(file_stream(spark, path, schema), f"{folder}/rows", f"{folder}/state").awaitTermination()
    rows = spark.read.option("basePath", f"{folder}/rows").parquet(f"{folder}/rows")
    return latest(rows, key, F.desc_nulls_last(version), F.desc("batch")).drop("batch")


def deduplicated(stream: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """Rows whose key was not seen within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """Counts per window and type with a watermark for late rows."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "w.end", "event_type", "n")
