"""Row rules, one registry for the validator, its queries and the tests."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType, TimestampNTZType

from claimloom.functions import blank, unit, unit_or_null
from claimloom.schema import DOMAINS


@dataclass(frozen=True)
class Rule:
    """A predicate that every row of a relation has to meet."""

    rule_id: str
    relation: str
    field: str
    holds: Callable[[], Column]
    error: str = "ContractViolation"


def _filled(f: str) -> Callable[[], Column]:
    return lambda: ~blank(f)


def _score(f: str) -> Callable[[], Column]:
    return lambda: unit_or_null(f)


def _positive(f: str) -> Callable[[], Column]:
    return lambda: F.col(f) > 0


_BAD = "InvalidRequest"
RULES: tuple[Rule, ...] = (
    Rule("V01", "requests", "question", _filled("question"), _BAD),
    Rule("V02", "requests", "profiles", lambda: ~F.exists("profiles", blank), _BAD),
    Rule("V03", "requests", "max_knowledge_results", _positive("max_knowledge_results"), _BAD),
    Rule("V04", "requests", "max_web_results", _positive("max_web_results"), _BAD),
    Rule("V05", "requests", "max_web_pages", _positive("max_web_pages"), _BAD),
    Rule("V06", "sources", "source_id", _filled("source_id")),
    Rule("V07", "evidence", "provenance.source_id", _filled("provenance.source_id")),
    Rule("V09", "evidence", "provenance.retrieval_rank",
         lambda: F.col("provenance.retrieval_rank").isNull() | (F.col("provenance.retrieval_rank") >= 0)),
    Rule("V10", "evidence", "provenance.retrieval_score", _score("provenance.retrieval_score")),
    Rule("V11", "evidence", "provenance.extraction_confidence", _score("provenance.extraction_confidence")),
    Rule("V12", "evidence", "quality.relevance", _score("quality.relevance")),
    Rule("V13", "evidence", "quality.authority", _score("quality.authority")),
    Rule("V14", "evidence", "quality.recency", _score("quality.recency")),
    Rule("V15", "evidence", "quality.extraction_confidence", _score("quality.extraction_confidence")),
    Rule("V16", "evidence", "claim_links.claim_id", lambda: ~F.exists("claim_links", lambda x: blank(x["claim_id"]))),
    Rule("V17", "evidence", "claim_links.confidence",
         lambda: F.forall("claim_links", lambda x: F.coalesce(unit(x["confidence"]), F.lit(False)))),
    Rule("V18", "evidence", "evidence_id", _filled("evidence_id")),
    Rule("V19", "evidence", "content", _filled("content")),
    Rule("V20", "evidence", "source_id", _filled("source_id")),
    Rule("V22", "claims", "claim_id", _filled("claim_id")),
    Rule("V23", "claims", "statement", _filled("statement")),
    Rule("V24", "claims", "confidence", lambda: unit("confidence")),
    Rule("V25", "contradictions", "contradiction_id", _filled("contradiction_id")),
    Rule("V26", "contradictions", "description", _filled("description")),
    # entries, not distinct ones: the same claim named twice passes
    Rule("V27", "contradictions", "claim_ids",
         lambda: F.coalesce(F.size("claim_ids"), F.lit(0)) + F.coalesce(F.size("evidence_ids"), F.lit(0)) >= 2),
    Rule("V28", "gaps", "gap_id", _filled("gap_id")),
    Rule("V29", "gaps", "description", _filled("description")),
    Rule("V30", "open_questions", "question", _filled("question")),
    Rule("V31", "dimensions", "score", _score("score")),
    Rule("V32", "diagnostics", "composite", _score("composite")),
    Rule("V33", "trace_events", "event_id", _filled("event_id")),
    Rule("V34", "trace_events", "message", _filled("message")),
    # negated: NaN passes
    Rule("V36", "trace_events", "duration_ms", lambda: F.col("duration_ms").isNull() | ~(F.col("duration_ms") < 0)),
    Rule("V37", "syntheses", "narrative", _filled("narrative")),
    Rule("V39", "syntheses", "confidence", _score("confidence")),
)

#: Time zones are part of a column's type: these must not be zone-less.
AWARE: tuple[tuple[str, str, str], ...] = (
    ("V08", "evidence", "provenance.retrieved_at"), ("V21", "evidence", "observed_at"),
    ("V35", "trace_events", "occurred_at"), ("V38", "syntheses", "synthesized_at"), ("V40", "results", "completed_at"),
)

#: Domain checks are stricter than the contract and have their own class.
DOMAIN_RULES: tuple[tuple[str, str, str], ...] = (
    ("sources", "source_type", "source_type"), ("claims", "claim_type", "claim_type"),
    ("claims", "status", "claim_status"), ("contradictions", "contradiction_type", "contradiction_type"),
    ("contradictions", "severity", "severity"), ("contradictions", "resolution_status", "resolution_status"),
    ("gaps", "gap_type", "gap_type"), ("gaps", "severity", "severity"), ("gaps", "status", "gap_status"),
    ("open_questions", "priority", "priority"), ("trace_events", "stage", "stage"),
    ("trace_events", "status", "event_status"), ("results", "status", "result_status"),
)


def type_of(df: DataFrame, path: str) -> DataType | None:
    """Type of a column or of a field inside structs and arrays of them."""
    kind: DataType | None = df.schema
    for part in path.split("."):
        if isinstance(kind, ArrayType):
            kind = kind.elementType
        found = [x.dataType for x in kind if x.name == part] if isinstance(kind, StructType) else []
        if not found:
            return None
        kind = found[0]
    return kind


def row_violations(relation: str, df: DataFrame, rules: tuple[str, ...] | None = None) -> DataFrame:
    """``result_id, relation, pos, rule_id, error`` of every broken rule.

    All rules of a relation run in one scan, without a shuffle.  A null
    where a value is required breaks the rule, too, with error
    ``missing``; rules on absent columns are skipped.
    """
    found = []
    for r in RULES:
        if r.relation == relation and (rules is None or r.rule_id in rules) and type_of(df, r.field) is not None:
            holds = r.holds()
            found.append(
                F.when(holds.isNull(), F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit("missing").alias("error")))
                .when(~holds, F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.error).alias("error")))
            )
    if not found:
        return df.select(
            "result_id", F.lit(relation).alias("relation"), "pos", F.lit("").alias("rule_id"), F.lit("").alias("error")
        ).where(F.lit(False))
    return df.select(
        "result_id", "pos", F.explode(F.array_compact(F.array(*found))).alias("v")
    ).select("result_id", F.lit(relation).alias("relation"), "pos", "v.rule_id", "v.error")


def zone_violations(relations: dict[str, DataFrame]) -> list[tuple[str, str, str]]:
    """Rules whose time column is zone-less: (rule, relation, column)."""
    return [
        (rule, relation, field) for rule, relation, field in AWARE
        if relation in relations and isinstance(type_of(relations[relation], field), TimestampNTZType)
    ]


def domain_violations(relation: str, df: DataFrame) -> DataFrame:
    """Values outside their enumeration (not part of the contract)."""
    bad = [
        F.when(~F.coalesce(F.col(f).isin(*DOMAINS[d]), F.lit(False)), F.lit(f))
        for rel, f, d in DOMAIN_RULES if rel == relation and f in df.columns
    ]
    return df.select(
        "result_id", F.lit(relation).alias("relation"), "pos",
        F.explode(F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>")).alias("field"),
    )
