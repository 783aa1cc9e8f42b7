"""Graph constraints against an independent model on random graphs."""

from __future__ import annotations

import random

import pytest

from claimloom.errors import ContractViolation, InvalidRequest
from claimloom.functions.serialize import serialize_results
from claimloom.operators import accessors, validate
from tests.test_rules import GOOD, frame


def model(g: dict) -> list[tuple]:
    """Violations of one graph as (order, rule), by plain loops."""
    out = []
    if g["status"] == "complete" and not g["sources"]:
        out.append(((1, 0, 0, 0), "C01"))
    names = {"sources": "source_id", "evidence": "evidence_id", "claims": "claim_id", "contradictions": "contradiction_id", "gaps": "gap_id"}
    for k, (rel, col) in enumerate(names.items()):
        seen, hit = set(), None
        for i, row in enumerate(g[rel]):
            if row[col] in seen and hit is None:
                hit = i
            seen.add(row[col])
        if hit is not None:
            out.append(((2 + k, hit, 0, 0), f"U0{k + 1}"))
    ids = {rel: {r[col] for r in g[rel]} for rel, col in names.items()}
    for i, e in enumerate(g["evidence"]):
        if e["source_id"] not in ids["sources"]:
            out.append(((7, i, 0, 0), "R01"))
        out += [((7, i, 1, j), "R02") for j, x in enumerate(e["claim_links"]) if x["claim_id"] not in ids["claims"]]
    for phase, rel, pairs in (
        (8, "claims", (("supporting_evidence_ids", "evidence", "R03"), ("conflicting_evidence_ids", "evidence", "R04"))),
        (9, "contradictions", (("claim_ids", "claims", "R05"), ("evidence_ids", "evidence", "R06"))),
        (10, "gaps", (("related_claim_ids", "claims", "R07"), ("related_evidence_ids", "evidence", "R08"))),
        (11, "open_questions", (("related_claim_ids", "claims", "R09"), ("related_gap_ids", "gaps", "R10"))),
    ):
        for i, row in enumerate(g[rel]):
            for sub, (col, target, rule) in enumerate(pairs):
                out += [((phase, i, sub, j), rule) for j, x in enumerate(row[col]) if x not in ids[target]]
    return sorted(out)


def random_graph(rng: random.Random) -> dict:
    some = lambda p: [f"{p}{rng.randrange(4)}" for _ in range(rng.randrange(3))]
    n = lambda: range(rng.randrange(4))
    one = lambda p: f"{p}{rng.randrange(4)}"
    return {
        "status": rng.choice(["complete", "partial"]),
        "sources": [{"source_id": one("s")} for _ in n()],
        "evidence": [{**GOOD["evidence"], "evidence_id": one("e"), "source_id": one("s"),
                      "claim_links": [{"claim_id": c, "confidence": 0.5} for c in some("c")]} for _ in n()],
        "claims": [{**GOOD["claims"], "claim_id": one("c"), "supporting_evidence_ids": some("e"), "conflicting_evidence_ids": some("e")} for _ in n()],
        "contradictions": [{**GOOD["contradictions"], "contradiction_id": one("x"), "claim_ids": some("c"), "evidence_ids": some("e")} for _ in n()],
        "gaps": [{**GOOD["gaps"], "gap_id": one("g"), "related_claim_ids": some("c"), "related_evidence_ids": some("e")} for _ in n()],
        "open_questions": [{**GOOD["open_questions"], "related_claim_ids": some("c"), "related_gap_ids": some("g")} for _ in n()],
    }


def relations(spark, graphs: list[dict]) -> dict:
    out = {"results": frame(spark, "results", [{"result_id": str(k), "status": g["status"]} for k, g in enumerate(graphs)])}
    for rel in ("sources", "evidence", "claims", "contradictions", "gaps", "open_questions"):
        rows = [{**row, "result_id": str(k), "pos": i} for k, g in enumerate(graphs) for i, row in enumerate(g[rel])]
        out[rel] = frame(spark, rel, rows)
    return out


def test_random_graphs(spark):
    rng = random.Random(7)
    graphs = [random_graph(rng) for _ in range(150)]
    r = relations(spark, graphs)
    got: dict[str, list] = {str(k): [] for k in range(len(graphs))}
    for v in validate.graph_violations(r).collect():
        got[v.result_id].append(((v.phase, v["item"], v["sub"], v.sub_pos), v.rule_id))
    first = {v.result_id: v.rule_id for v in validate.first_violations(r).collect()}
    good = {v.result_id for v in validate.valid_results(r).collect()}
    for k, g in enumerate(graphs):
        want = model(g)
        assert sorted(got[str(k)]) == want
        assert first.get(str(k)) == (want[0][1] if want else None)
        assert (str(k) in good) == (not want)


FULL = {
    "status": "complete", "sources": [{"source_id": "s1"}],
    "evidence": [{**GOOD["evidence"], "evidence_id": "e1", "source_id": "s1", "claim_links": []}],
    "claims": [{**GOOD["claims"], "claim_id": "c1", "supporting_evidence_ids": ["e1"]}], "contradictions": [],
    "gaps": [{**GOOD["gaps"], "gap_id": "g1", "related_claim_ids": ["c1"]}],
    "open_questions": [{"question": "what?", "related_gap_ids": ["g1"]}],
}


def test_check_raises(spark):
    validate.check(relations(spark, [FULL]))
    with pytest.raises(ContractViolation):
        validate.check(relations(spark, [{**FULL, "sources": []}]))
    with pytest.raises(InvalidRequest):
        validate.check({"requests": frame(spark, "requests", [{"question": " "}])})


def test_ids_are_not_trimmed(spark):
    g = {**FULL, "sources": [{"source_id": "s1"}, {"source_id": "s1 "}]}
    assert validate.first_violations(relations(spark, [g])).isEmpty()


def test_serialised_result(spark):
    import json

    got = json.loads(serialize_results(relations(spark, [FULL])).first().json)
    assert got["sources"][0]["source_id"] == "s1" and got["sources"][0]["url"] is None
    assert got["contradictions"] == [] and got["claims"][0]["supporting_evidence_ids"] == ["e1"]


def test_times_are_iso(spark):
    from claimloom.functions import iso_timestamp

    df = spark.sql("SELECT explode(array(timestamp'2024-01-15 12:00:00+00:00', timestamp'2024-01-15 12:00:00.000120+00:00')) AS t")
    assert [r[0] for r in df.select(iso_timestamp("t")).collect()] == ["2024-01-15T12:00:00+00:00", "2024-01-15T12:00:00.000120+00:00"]


def test_overrides_of_zero_count(spark):
    req = frame(spark, "requests", [{"result_id": "r", "question": "q", "max_knowledge_results": 15}])
    over = spark.createDataFrame([("r", "knowledge", 0, None, ""), ("r", "knowledge", None, 2, None)],
                                 "result_id string, kind string, max_results bigint, max_pages bigint, language string")
    got = sorted((r.effective_max_results, r.effective_max_pages, r.effective_language) for r in accessors.effective_limits(over, req).collect())
    assert got == [(0, 5, ""), (15, 2, "en")]
