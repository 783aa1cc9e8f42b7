"""Gaps: one branch per condition, all of one shape, and open questions.

``facts`` has one row per subject (a request, a publisher, ...) with
what is known about it; every branch is a filter on it, so the analysis
is one scan however many conditions there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Thresholds of the conditions.
LEAST_COVERAGE, LEAST_AUTHORITY, LEAST_CONFIDENCE, STALE_DAYS = 0.5, 0.4, 0.6, 20


def conditions() -> dict[str, tuple[str, str, Column]]:
    """Name -> (gap type, severity, predicate on the facts)."""
    c = F.col
    return {
        "no_sources": ("no_evidence", "high", c("n_sources") == 0),
        "no_evidence": ("no_evidence", "critical", (c("n_sources") > 0) & (c("n_evidence") == 0)),
        "missing_dimension": ("missing_dimension", "medium", c("n_dimensions") < c("n_expected")),
        "coverage": ("insufficient_coverage", "medium",
                     (c("n_evidence") > 0) & (c("n_dimensions") < LEAST_COVERAGE * c("n_expected"))),
        "authority": ("weak_authority", "medium", c("authority") < LEAST_AUTHORITY),
        "uncorroborated": ("uncorroborated_claim", "medium", (c("n_evidence") > 0) & (c("n_sources") < 2)),
        "unresolved": ("unresolved_contradiction", "high", c("n_conflicts") > 0),
        "stale": ("stale_evidence", "low", c("age_days") > STALE_DAYS),
        "confidence": ("low_extraction_confidence", "low", c("confidence") < LEAST_CONFIDENCE),
    }


def gaps(facts: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``subject, condition, gap_type, severity`` of all met conditions.
    Null facts meet none."""
    found = [
        F.when(p, F.struct(F.lit(n).alias("condition"), F.lit(t).alias("gap_type"), F.lit(s).alias("severity")))
        for n, (t, s, p) in conditions().items() if names is None or n in names
    ]
    return facts.select("subject", F.explode(F.array_compact(F.array(*found))).alias("g")).select("subject", "g.*")


def open_questions(found: DataFrame) -> DataFrame:
    """A question per gap above low severity, with its priority."""
    return found.where(F.col("severity") != "low").select(
        "subject", "gap_type",
        F.concat(F.lit("How can "), F.translate("gap_type", "_", " "), F.lit(" of "), "subject", F.lit(" be resolved?")).alias("question"),
        F.when(F.col("severity").isin("high", "critical"), "high").otherwise("medium").alias("priority"),
    )
