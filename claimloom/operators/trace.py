"""Summaries of execution traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stage_summary(events: DataFrame) -> DataFrame:
    """Events and failures per stage and status, with totals (rollup)."""
    return events.rollup("stage", "status").agg(F.count("*").alias("n"))


def durations(events: DataFrame) -> DataFrame:
    """Number and extremes of durations per stage; null ones are counted
    apart, not as zero."""
    return events.groupBy("stage").agg(
        F.count("*").alias("n"), F.count("duration_ms").alias("n_timed"),
        F.min("duration_ms").alias("shortest"), F.max("duration_ms").alias("longest"),
    )
