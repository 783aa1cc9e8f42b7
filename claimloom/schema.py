"""Relations of an evidence graph, their columns, defaults and domains.

Every relation has ``result_id`` (the graph it belongs to) and ``pos``
(its place in that graph).  Null scores mean "not assessed", never zero.
"""

from __future__ import annotations

from pyspark.sql.types import StructType

# Domains of the enumerations.
DOMAINS: dict[str, tuple[str, ...]] = {
    "source_type": ("knowledge", "web"),
    "relationship": ("supports", "weakens", "contradicts", "neutral"),
    "claim_type": ("factual", "analytical", "predictive", "normative", "definitional", "other"),
    "claim_status": ("supported", "partially_supported", "contested", "unsupported", "unresolved"),
    "contradiction_type": (
        "numeric", "temporal", "definitional", "scope", "methodological", "entity_identity", "categorical", "other",
    ),
    "severity": ("low", "medium", "high", "critical"),
    "resolution_status": ("unresolved", "acknowledged", "resolved"),
    "gap_type": (
        "no_evidence", "insufficient_coverage", "weak_authority", "uncorroborated_claim", "stale_evidence",
        "unresolved_contradiction", "low_extraction_confidence", "missing_dimension",
        "methodological_uncertainty", "inconsistent_definition", "other",
    ),
    "gap_status": ("open", "acknowledged", "addressed"),
    "priority": ("low", "medium", "high"),
    "stage": (
        "init", "profile_resolution", "retrieval", "extraction", "claim_analysis", "contradiction_detection",
        "gap_analysis", "synthesis", "rendering", "finalization", "other",
    ),
    "event_status": ("started", "completed", "skipped", "failed", "partial"),
    "result_status": ("complete", "partial"),
}

# Quality dimensions in order; those where less is better.
DIMENSIONS = (
    "relevance", "authority", "recency", "corroboration", "independence", "coverage", "extraction_confidence",
    "contradiction_severity", "uncertainty", "completeness", "provenance_completeness", "reproducibility",
)
LOWER_IS_BETTER = ("contradiction_severity", "uncertainty")

_PROVENANCE = (
    "struct<source_id:string,source_type:string,retrieved_at:timestamp,document_id:string,url:string,"
    "provider:string,retrieval_query:string,retrieval_rank:bigint,retrieval_score:double,"
    "extraction_method:string,extraction_confidence:double,content_hash:string,metadata:string>"
)
_QUALITY = "struct<relevance:double,authority:double,recency:double,extraction_confidence:double,notes:string>"
_LINKS = "array<struct<claim_id:string,relationship:string,confidence:double,notes:string>>"

#: Columns of each relation, without ``result_id`` and ``pos``.
RELATIONS: dict[str, str] = {
    "requests": "question string, profiles array<string>, use_knowledge boolean, use_web boolean, "
    "max_knowledge_results bigint, max_web_results bigint, max_web_pages bigint, language string, "
    "as_of_date date, strict boolean, metadata string",
    "results": "status string, completed_at timestamp, metadata string",
    "sources": "source_id string, source_type string, title string, url string, document_id string, "
    "publisher string, author string, publication_date date, retrieved_at timestamp, metadata string",
    "evidence": f"evidence_id string, content string, source_id string, provenance {_PROVENANCE}, "
    f"quality {_QUALITY}, claim_links {_LINKS}, locator string, observed_at timestamp, metadata string",
    "claims": "claim_id string, statement string, claim_type string, scope string, qualifiers array<string>, "
    "supporting_evidence_ids array<string>, conflicting_evidence_ids array<string>, confidence double, "
    "status string, metadata string",
    "contradictions": "contradiction_id string, contradiction_type string, description string, "
    "claim_ids array<string>, evidence_ids array<string>, severity string, resolution_status string, "
    "resolution_notes string, metadata string",
    "gaps": "gap_id string, gap_type string, description string, related_claim_ids array<string>, "
    "related_evidence_ids array<string>, severity string, recommended_action string, status string, metadata string",
    "open_questions": "question string, reason string, priority string, related_claim_ids array<string>, "
    "related_gap_ids array<string>, metadata string",
    "dimensions": "dim string, score double, notes string, flags array<string>",
    "diagnostics": "composite double, metadata string",
    "trace_events": "event_id string, stage string, status string, message string, occurred_at timestamp, "
    "duration_ms double, payload string, metadata string",
    "syntheses": "narrative string, key_findings array<string>, synthesis_model string, "
    "synthesized_at timestamp, confidence double, metadata string",
}

#: Defaults of fields that are never null (others stay null).
DEFAULTS: dict[str, dict[str, object]] = {
    "requests": {
        "profiles": [], "use_knowledge": True, "use_web": False, "max_knowledge_results": 10,
        "max_web_results": 5, "max_web_pages": 5, "language": "en", "strict": False, "metadata": "{}",
    },
    "results": {"metadata": "{}"},
    "sources": {"title": "", "metadata": "{}"},
    "evidence": {"claim_links": [], "metadata": "{}"},
    "claims": {
        "claim_type": "factual", "scope": "", "qualifiers": [], "supporting_evidence_ids": [],
        "conflicting_evidence_ids": [], "confidence": 0.0, "status": "unresolved", "metadata": "{}",
    },
    "contradictions": {
        "claim_ids": [], "evidence_ids": [], "severity": "medium", "resolution_status": "unresolved",
        "resolution_notes": "", "metadata": "{}",
    },
    "gaps": {
        "related_claim_ids": [], "related_evidence_ids": [], "severity": "medium", "recommended_action": "",
        "status": "open", "metadata": "{}",
    },
    "open_questions": {
        "reason": "", "priority": "medium", "related_claim_ids": [], "related_gap_ids": [], "metadata": "{}",
    },
    "dimensions": {"notes": "", "flags": []},
    "diagnostics": {"metadata": "{}"},
    "trace_events": {"metadata": "{}"},
    "syntheses": {"key_findings": [], "metadata": "{}"},
}


def schema_of(relation: str) -> StructType:
    """Full schema of a relation."""
    return StructType.fromDDL(f"result_id string, pos bigint, {RELATIONS[relation]}")
