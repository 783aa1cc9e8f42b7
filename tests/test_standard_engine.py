"""The built-in stages, from requests to Markdown."""

from __future__ import annotations

import pytest

from claimloom import errors
from claimloom.plans import stages
from claimloom.plans.engine import Engine

ROWS = [
    ("a", 0, "e1", "Rain fell on 10 days. It was cold.", "s1", "p1"),
    ("a", 1, "e2", "Rain fell on 30 days. It was cold.", "s2", "p2"),
    ("b", 0, "e1", "Only this.", "s1", "p1"),
]


class Fixed:
    def __init__(self, spark):
        self.spark = spark

    def retrieve(self, requests):
        df = self.spark.createDataFrame(ROWS, "result_id string, pos long, evidence_id string, content string, source_id string, publisher string")
        return df.join(requests.select("result_id"), "result_id")


class Fails:
    def __getattr__(self, name):
        def call(*_):
            raise RuntimeError("no")

        return call


def asked(spark, *ids, strict=()):
    return spark.createDataFrame([(i, 0, "what?", i in strict) for i in ids], "result_id string, pos long, question string, strict boolean")


def engine(spark, **more):
    own = dict(extractor=stages.SentenceClaims(), detector=stages.NumberConflicts(), gaps=stages.FactGaps(),
               synthesizer=stages.CountSynthesis(), renderer=stages.Markdown())
    return Engine(spark, knowledge=Fixed(spark), **(own | more))


def test_all_stages(spark):
    e = engine(spark)
    out = e.run(asked(spark, "a", "b", "c"))
    assert {r.result_id: r.status for r in out.relations["results"].collect()} == {"a": "complete", "b": "complete", "c": "partial"}
    claims = {(r.result_id, r.statement): (r.status, r.supporting_evidence_ids) for r in out.relations["claims"].collect()}
    assert claims["a", "It was cold."] == ("supported", ["e1", "e2"]) and claims["b", "Only this."] == ("partially_supported", ["e1"])
    (x,) = out.relations["contradictions"].collect()
    assert (x.result_id, len(x.claim_ids), x.severity) == ("a", 2, "high")
    gaps = {(r.result_id, r.gap_type) for r in out.relations["gaps"].collect()}
    assert {("a", "unresolved_contradiction"), ("b", "uncorroborated_claim"), ("c", "no_evidence")} <= gaps
    lines = [r.line for r in out.rendered.collect() if r.result_id == "a"]
    assert lines[0] == "# Result a (complete)" and lines.index("## Claims") < lines.index("## Gaps")
    events = out.events().where("result_id = 'a'").orderBy("pos").collect()
    assert [r.stage for r in events][-1] == "finalization"
    e.release()


def test_gaps_without_any_evidence(spark):
    out = engine(spark).run(asked(spark, "c"))
    assert out.status == "partial" and [r.gap_type for r in out.relations["gaps"].collect()].count("no_evidence") == 1


def test_a_strict_request_counts_alone(spark):
    engine(spark).run(asked(spark, "a", "c", strict=("a",)))
    with pytest.raises(errors.IncompleteResult) as x:
        engine(spark).run(asked(spark, "a", "c", strict=("c",)))
    assert x.value.results == ["c"]


@pytest.mark.parametrize("stage", ["extractor", "detector", "gaps"])
def test_failed_stages_leave_partial_results(spark, stage):
    broken = type("Broken", (Fails,), {k: lambda self, *a: 1 / 0 for k in ("extract", "detect", "analyze")})()
    out = engine(spark, **{stage: broken}).run(asked(spark, "a"))
    assert out.status == "partial" and out.relations["results"].first().status == "partial"


def test_a_broken_renderer_spoils_nothing(spark):
    broken = type("Broken", (), {"render": lambda self, r: 1 / 0})()
    out = engine(spark, renderer=broken).run(asked(spark, "a"))
    assert out.status == "complete" and out.rendered is None


def test_a_broken_graph_is_refused(spark):
    class Twice(stages.SentenceClaims):
        def extract(self, evidence, requests):
            c = super().extract(evidence, requests)
            return c.unionByName(c)

    with pytest.raises(errors.ContractViolation) as x:
        engine(spark, extractor=Twice()).run(asked(spark, "a"))
    assert x.value.rows and "rules" in str(x.value)


def test_small_tables_keep_their_matches(spark):
    from claimloom.operators.retrieve import retrieve

    docs = spark.createDataFrame([(i, "common words here" + (" rare" if i == 7 else "")) for i in range(40)], "doc_id long, text string")
    q = spark.createDataFrame([("r", "common rare")], "request_id string, question string")
    rows = retrieve(q, docs, 3).orderBy("rank").collect()
    assert [(r.doc_id, r.n_shared) for r in rows] == [(7, 2), (0, 1), (1, 1)]


def test_long_ids_count_in_full(spark):
    from claimloom.operators.render import findings

    df = lambda ids: spark.createDataFrame([(i, "supported") for i in ids], "claim_id string, status string")
    one, two = (findings(df(x)).first().ids_md5 for x in (["a" * 15 + "b"], ["a" * 15 + "c"]))
    assert one != two


def test_many_short_passages(spark):
    from claimloom.operators.claims import passages_in

    docs = spark.createDataFrame([(i, f"x{i} y{i}z") for i in range(1100)] + [(5000, "")], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"x{i} y{i}") for i in range(1100)] + [(7000, "z")], "item_id long, text string")
    found = {(r.item_id, r.doc_id) for r in passages_in(docs, items).collect()}
    want = {(i, d) for i in range(1100) for d in [i]} | {(7000, d) for d in range(1100)}
    assert found == want
