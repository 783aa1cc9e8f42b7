"""Filters, projections and effective values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.errors import UnknownProfile
from claimloom.schema import DIMENSIONS


def events_of_stage(events: DataFrame, stage: str) -> DataFrame:
    """Trace events of a stage; sort by ``result_id, pos`` for their order."""
    return events.where(F.col("stage") == stage)


def failed_events(events: DataFrame) -> DataFrame:
    """Trace events that failed."""
    return events.where(F.col("status") == "failed")


def dimensions(wide: DataFrame) -> DataFrame:
    """Twelve rows ``dim, score`` a graph, nulls (not assessed) kept."""
    return wide.unpivot("result_id", list(DIMENSIONS), "dim", "score")


def available_dimensions(wide: DataFrame) -> DataFrame:
    """Only the assessed ones; zero is assessed."""
    return dimensions(wide).where(F.col("score").isNotNull())


def with_flags(results: DataFrame) -> DataFrame:
    """``is_complete`` and ``is_partial``."""
    return results.withColumn("is_complete", F.col("status") == "complete").withColumn(
        "is_partial", F.col("status") == "partial"
    )


def has_profiles(requests: DataFrame) -> DataFrame:
    """``has_profiles``; null profiles are none."""
    return requests.withColumn("has_profiles", F.coalesce(F.size("profiles"), F.lit(0)) > 0)


def effective_limits(retrievals: DataFrame, requests: DataFrame) -> DataFrame:
    """Overrides where given - zero, negatives and the empty string count -
    else the parent request's values."""
    r = requests.select(
        "result_id", "max_knowledge_results", "max_web_results", "max_web_pages", F.col("language").alias("parent_language")
    )
    return retrievals.join(r, "result_id").withColumns(
        {
            "effective_max_results": F.coalesce(
                "max_results", F.when(F.col("kind") == "web", F.col("max_web_results")).otherwise(F.col("max_knowledge_results"))
            ),
            "effective_max_pages": F.coalesce("max_pages", "max_web_pages"),
            "effective_language": F.coalesce("language", "parent_language"),
        }
    ).drop("max_knowledge_results", "max_web_results", "max_web_pages", "parent_language")


def resolve_profiles(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """Profiles of each request in its order; unknown ones are absent."""
    asked = requests.select("result_id", F.posexplode("profiles").alias("pos", "profile_id"))
    return asked.join(profiles, "profile_id")


def unknown_profiles(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """Asked profiles that no provider knows."""
    asked = requests.select("result_id", F.posexplode("profiles").alias("pos", "profile_id"))
    return asked.join(profiles, "profile_id", "left_anti").select("result_id", "pos", "profile_id")


def require_profiles(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """Resolved profiles; raises on the first unknown one."""
    missing = unknown_profiles(requests, profiles).orderBy("result_id", "pos").limit(1).collect()
    if missing:
        raise UnknownProfile(missing[0].profile_id)
    return resolve_profiles(requests, profiles)
