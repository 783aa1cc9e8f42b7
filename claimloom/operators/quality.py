"""Quality diagnostics: every dimension visible, an optional composite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.operators.accessors import available_dimensions
from claimloom.schema import DIMENSIONS, LOWER_IS_BETTER


def wide(facts: DataFrame) -> DataFrame:
    """Twelve columns; those that ``facts`` lacks are null."""
    return facts.select(
        "result_id", *(
            (F.col(d) if d in facts.columns else F.lit(None)).cast("double").alias(d) for d in DIMENSIONS
        )
    )


def composite(df: DataFrame) -> DataFrame:
    """Mean over the assessed dimensions, two of them inverted, beside the
    number of them; never a replacement for the dimensions."""
    better = F.when(F.col("dim").isin(*LOWER_IS_BETTER), 1 - F.col("score")).otherwise(F.col("score"))
    return available_dimensions(df).groupBy("result_id").agg(
        F.round(F.avg(better), 6).alias("composite"), F.count("*").alias("n_available")
    )
