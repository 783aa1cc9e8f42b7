"""Row rules case by case."""

from __future__ import annotations

import pytest

from claimloom.functions import WHITESPACE
from claimloom.operators.normalize import normalise_requests, with_defaults
from claimloom.operators.rules import RULES, domain_violations, row_violations, zone_violations
from claimloom.schema import RELATIONS, schema_of

GOOD = {
    "requests": {"question": "why?", "profiles": ["a"]},
    "sources": {"source_id": "s"},
    "evidence": {"evidence_id": "e", "content": "text", "source_id": "s", "provenance": {"source_id": "s", "retrieval_rank": 0},
                 "quality": {}, "claim_links": [{"claim_id": "c", "confidence": 0.0}]},
    "claims": {"claim_id": "c", "statement": "it is", "confidence": 1.0},
    "contradictions": {"contradiction_id": "x", "description": "d", "claim_ids": ["c", "c"]},
    "gaps": {"gap_id": "g", "description": "d"},
    "open_questions": {"question": "what?"},
    "dimensions": {"dim": "coverage", "score": 0.0},
    "diagnostics": {"composite": 1.0},
    "trace_events": {"event_id": "t", "message": "m", "duration_ms": 0.0},
    "syntheses": {"narrative": "n"},
}
NAN = float("nan")
CASES = [
    ("requests", {"question": ""}, "V01"), ("requests", {"question": "  \t"}, "V01"), ("requests", {"profiles": ["a", "  "]}, "V02"),
    ("requests", {"max_knowledge_results": 0}, "V03"), ("requests", {"max_web_results": -1}, "V04"), ("requests", {"max_web_pages": 0}, "V05"),
    ("sources", {"source_id": " "}, "V06"), ("evidence", {"provenance": {"source_id": " "}}, "V07"),
    ("evidence", {"provenance": {"source_id": "s", "retrieval_rank": -1}}, "V09"),
    ("evidence", {"provenance": {"source_id": "s", "retrieval_score": 1.5}}, "V10"),
    ("evidence", {"provenance": {"source_id": "s", "extraction_confidence": -0.1}}, "V11"),
    ("evidence", {"quality": {"relevance": NAN}}, "V12"), ("evidence", {"quality": {"authority": 2.0}}, "V13"),
    ("evidence", {"quality": {"recency": -1.0}}, "V14"), ("evidence", {"quality": {"extraction_confidence": 1.01}}, "V15"),
    ("evidence", {"claim_links": [{"claim_id": " ", "confidence": 1.0}]}, "V16"),
    ("evidence", {"claim_links": [{"claim_id": "c", "confidence": None}]}, "V17"),
    ("evidence", {"evidence_id": " "}, "V18"), ("evidence", {"content": "\n"}, "V19"), ("evidence", {"source_id": ""}, "V20"),
    ("claims", {"claim_id": ""}, "V22"), ("claims", {"statement": " "}, "V23"), ("claims", {"confidence": 1.1}, "V24"),
    ("contradictions", {"contradiction_id": " "}, "V25"), ("contradictions", {"description": ""}, "V26"),
    ("contradictions", {"claim_ids": ["c"]}, "V27"), ("contradictions", {"claim_ids": []}, "V27"),
    ("gaps", {"gap_id": ""}, "V28"), ("gaps", {"description": " "}, "V29"), ("open_questions", {"question": " "}, "V30"),
    ("dimensions", {"score": 1.2}, "V31"), ("diagnostics", {"composite": NAN}, "V32"), ("trace_events", {"event_id": ""}, "V33"),
    ("trace_events", {"message": "\t"}, "V34"), ("trace_events", {"duration_ms": -1.0}, "V36"), ("syntheses", {"narrative": ""}, "V37"),
    ("syntheses", {"confidence": 3.0}, "V39"),
]


def frame(spark, relation, rows):
    names = [f.name for f in schema_of(relation)]
    full = [tuple({"result_id": "r", "pos": i, **row}.get(n) for n in names) for i, row in enumerate(rows)]
    return with_defaults(relation, spark.createDataFrame(full, schema_of(relation)))


@pytest.mark.parametrize("relation", sorted(GOOD))
def test_each_rule(spark, relation):
    cases = [(change, rule) for rel, change, rule in CASES if rel == relation]
    df = frame(spark, relation, [GOOD[relation], *({**GOOD[relation], **c} for c, _ in cases)])
    got = sorted((r.pos, r.rule_id) for r in row_violations(relation, df).collect())
    assert got == [(i + 1, rule) for i, (_, rule) in enumerate(cases)]


def test_cases_cover_all_rules():
    assert {c[2] for c in CASES} == {r.rule_id for r in RULES}


def test_null_in_a_required_field_is_missing(spark):
    df = frame(spark, "claims", [{**GOOD["claims"], "statement": None}])
    assert [(r.rule_id, r.error) for r in row_violations("claims", df).collect()] == [("V23", "missing")]


def test_nan_duration_passes(spark):
    assert row_violations("trace_events", frame(spark, "trace_events", [{**GOOD["trace_events"], "duration_ms": NAN}])).isEmpty()


def test_whitespace_is_pythons(spark):
    for c in WHITESPACE:
        assert not c.strip()
    assert len(WHITESPACE) == 29


def test_requests_are_normalised(spark):
    df = normalise_requests(frame(spark, "requests", [{"question": "  why? ", "profiles": ["a ", "b", "a"]}]))
    row = df.first()
    assert (row.question, row.profiles, row.max_web_pages, row.language) == ("why?", ["a", "b"], 5, "en")


def test_zone_less_times(spark):
    df = spark.sql("SELECT 'r' AS result_id, 0L AS pos, struct(timestamp_ntz'2024-01-01 00:00:00' AS retrieved_at) AS provenance")
    assert zone_violations({"evidence": df}) == [("V08", "evidence", "provenance.retrieved_at")]


def test_domains(spark):
    df = frame(spark, "claims", [GOOD["claims"], {**GOOD["claims"], "claim_type": "odd"}])
    assert [r.field for r in domain_violations("claims", df).collect()] == ["claim_type"]


def test_empty_relations(spark):
    for relation in RELATIONS:
        assert row_violations(relation, frame(spark, relation, [])).isEmpty()
