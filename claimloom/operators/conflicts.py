"""Contradictions between claims.

Claims are compared within ``subject, attribute``: pairs come only from
groups whose spread shows a conflict, and run between each claim and the
group's extremes, so a large group yields a linear number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Relative spread at which numbers contradict, and severities from it.
TOLERANCE = 0.05
SEVERE = (("critical", 1.0), ("high", 0.5), ("medium", 0.2))


def severity(spread: Column | str) -> Column:
    """Severity of a relative spread."""
    c = F.col(spread) if isinstance(spread, str) else spread
    out = F.lit("low")
    for name, least in reversed(SEVERE):
        out = F.when(c >= least, F.lit(name)).otherwise(out)
    return out


def numeric(claims: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Groups ``subject, attribute`` whose values spread too far:
    ``low, high, n, spread, severity``.  NaN and null take no part."""
    v = claims.where(F.col("value").isNotNull() & ~F.isnan("value"))
    g = v.groupBy("subject", "attribute").agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n")
    )
    size = F.greatest(F.abs("low"), F.abs("high"))
    g = g.withColumn("spread", F.coalesce(F.try_divide(F.col("high") - F.col("low"), size), F.lit(0.0)))
    return g.where(F.col("spread") > tolerance).withColumn("severity", severity("spread"))


def numeric_pairs(claims: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Each claim against its group's lowest one, where both disagree."""
    groups = numeric(claims, tolerance)
    low = claims.join(groups.select("subject", "attribute", "low"), ["subject", "attribute"]).where("value = low")
    anchor = low.groupBy("subject", "attribute").agg(F.min("claim_id").alias("other_id"), F.min("low").alias("low"))
    size = F.greatest(F.abs("value"), F.abs("low"))
    return (
        claims.join(anchor, ["subject", "attribute"])
        .where(F.try_divide(F.col("value") - F.col("low"), size) > tolerance)
        .select("subject", "attribute", "claim_id", "other_id")
    )


def temporal(events: DataFrame) -> DataFrame:
    """Subjects that end before they begin (``starts``, ``ends``)."""
    return events.where(F.col("starts") > F.col("ends"))


def categorical(claims: DataFrame) -> DataFrame:
    """Groups with more than one category: their number and extremes."""
    return (
        claims.where(F.col("value").isNotNull()).groupBy("subject", "attribute")
        .agg(F.count_distinct("value").alias("n_values"), F.min("value").alias("first"), F.max("value").alias("last"))
        .where("n_values > 1")
    )


def scoped(claims: DataFrame) -> DataFrame:
    """Groups whose value holds in every scope but differs between scopes."""
    per = claims.groupBy("subject", "attribute", "scope").agg(
        F.min("value").alias("low"), F.max("value").alias("high")
    ).where("low = high")
    return (
        per.groupBy("subject", "attribute").agg(F.count("*").alias("n_scopes"), F.count_distinct("low").alias("n_values"))
        .where("n_values > 1")
    )
