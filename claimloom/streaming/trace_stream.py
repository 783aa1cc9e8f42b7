"""A growing trace: events are appended, summaries follow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, like: DataFrame, per_trigger: int = 100) -> DataFrame:
    """Stream of Parquet files with the schema of a trace."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def windowed(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and failures per stage and window; state older than the
    watermark is dropped, so it stays bounded."""
    return (
        events.withWatermark("occurred_at", late)
        .groupBy(F.window("occurred_at", window), "stage")
        .agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("n_failed"))
        .select(F.col("window.start").alias("start"), "stage", "n", "n_failed")
    )
