"""A small extra: manifests that arrive as files, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def manifest_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """Rows of JSON-lines manifests under ``path`` as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def status_counts(stream: DataFrame, time: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts by window, dataset and status of rows seen once each; rows later than ``late`` are left out, so state is bounded."""
    seen = stream.withWatermark(time, late).dropDuplicatesWithinWatermark(["path"])
    return seen.groupBy(F.window(time, window), "dataset", "status").agg(F.count("*").alias("n"))
