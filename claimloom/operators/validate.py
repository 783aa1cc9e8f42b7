"""Constraints over a whole graph: unique ids, references, status.

Uniqueness is a count per id, a reference check an anti-join on
``(result_id, id)``; Catalyst picks broadcast or sort-merge by size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.errors import ContractViolation, InvalidRequest
from claimloom.operators.rules import RULES, row_violations, type_of, zone_violations

#: Rule, relation, id column and phase of the uniqueness checks.
UNIQUE = (
    ("U01", "sources", "source_id", 2), ("U02", "evidence", "evidence_id", 3), ("U03", "claims", "claim_id", 4),
    ("U04", "contradictions", "contradiction_id", 5), ("U05", "gaps", "gap_id", 6),
)
#: Rule, holder, its column, target, target's id, holder's name, phase,
#: order within the holder (null array column: a single id).
REFERENCES = (
    ("R01", "evidence", "source_id", "sources", "source_id", "evidence_id", 7, 0),
    ("R02", "evidence", "claim_links.claim_id", "claims", "claim_id", "evidence_id", 7, 1),
    ("R03", "claims", "supporting_evidence_ids", "evidence", "evidence_id", "claim_id", 8, 0),
    ("R04", "claims", "conflicting_evidence_ids", "evidence", "evidence_id", "claim_id", 8, 1),
    ("R05", "contradictions", "claim_ids", "claims", "claim_id", "contradiction_id", 9, 0),
    ("R06", "contradictions", "evidence_ids", "evidence", "evidence_id", "contradiction_id", 9, 1),
    ("R07", "gaps", "related_claim_ids", "claims", "claim_id", "gap_id", 10, 0),
    ("R08", "gaps", "related_evidence_ids", "evidence", "evidence_id", "gap_id", 10, 1),
    ("R09", "open_questions", "related_claim_ids", "claims", "claim_id", "question", 11, 0),
    ("R10", "open_questions", "related_gap_ids", "gaps", "gap_id", "question", 11, 1),
)
Relations = dict[str, DataFrame]


def duplicates(df: DataFrame, id_col: str) -> DataFrame:
    """``result_id``, id and ``n`` of ids that occur more than once."""
    return df.groupBy("result_id", id_col).agg(F.count("*").alias("n")).where("n > 1")


def first_duplicate(df: DataFrame, id_col: str) -> DataFrame:
    """Per graph the id whose second occurrence comes first."""
    w = Window.partitionBy("result_id", id_col).orderBy("pos")
    second = df.select("result_id", "pos", id_col, F.row_number().over(w).alias("nth")).where("nth = 2")
    return second.groupBy("result_id").agg(F.min("pos").alias("pos"), F.min_by(id_col, "pos").alias(id_col))


def references(rule: str, relations: Relations) -> DataFrame:
    """``result_id, pos, holder, ref_pos, ref`` of a reference rule."""
    _, holder, column, _, _, name, _, _ = next(r for r in REFERENCES if r[0] == rule)
    df = relations[holder]
    holder_name = F.substring(name, 1, 40) if name == "question" else F.col(name)
    base = ["result_id", "pos", holder_name.alias("holder")]
    if column == "source_id":
        return df.select(*base, F.lit(0).alias("ref_pos"), F.col(column).alias("ref"))
    return df.select(*base, F.posexplode(column).alias("ref_pos", "ref"))


def dangling(rule: str, relations: Relations) -> DataFrame:
    """References of a rule whose target does not exist."""
    _, _, _, target, target_id, *_ = next(r for r in REFERENCES if r[0] == rule)
    known = relations[target].select("result_id", F.col(target_id).alias("ref"))
    return references(rule, relations).join(known, ["result_id", "ref"], "left_anti").select(
        "result_id", "pos", "holder", "ref_pos", "ref"
    )


def complete_without_sources(relations: Relations) -> DataFrame:
    """Complete results that have no source."""
    return (
        relations["results"].where(F.col("status") == "complete")
        .join(relations["sources"], "result_id", "left_anti").select("result_id")
    )


def graph_violations(relations: Relations) -> DataFrame:
    """All violations: ``result_id, rule_id, value, phase, item, sub,
    sub_pos``, the last four being the order in which they would be met.

    All reference rules share one anti-join and all uniqueness rules one
    window: ids carry the relation they belong to, so the graph is
    shuffled once for either kind however many rules there are.
    """
    order = ("phase", "item", "sub", "sub_pos")
    out, refs, known, ids = [], [], [], []
    if "results" in relations and "sources" in relations:
        out.append(
            complete_without_sources(relations).select(
                "result_id", F.lit("C01").alias("rule_id"), F.lit("").alias("value"), F.lit(1).alias("phase"),
                F.lit(0).cast("bigint").alias("item"), F.lit(0).alias("sub"), F.lit(0).alias("sub_pos"),
            )
        )
    has = lambda relation, column: relation in relations and type_of(relations[relation], column) is not None
    for rule, relation, id_col, phase in UNIQUE:
        if has(relation, id_col):
            ids.append(
                relations[relation].select(
                    "result_id", F.lit(rule).alias("rule_id"), F.col(id_col).alias("value"), F.lit(phase).alias("phase"),
                    F.col("pos").cast("bigint").alias("item"), F.lit(0).alias("sub"), F.lit(0).alias("sub_pos"),
                )
            )
    for rule, holder, column, target, target_id, name, phase, sub in REFERENCES:
        if has(holder, column) and has(holder, name) and has(target, target_id):
            refs.append(
                references(rule, relations).select(
                    "result_id", F.lit(rule).alias("rule_id"), F.lit(target).alias("kind"), "ref",
                    F.concat_ws(" -> ", "holder", "ref").alias("value"), F.lit(phase).alias("phase"),
                    F.col("pos").cast("bigint").alias("item"), F.lit(sub).alias("sub"), F.col("ref_pos").alias("sub_pos"),
                )
            )
    for target, id_col in sorted({(r[3], r[4]) for r in REFERENCES}):
        if has(target, id_col):
            known.append(relations[target].select("result_id", F.lit(target).alias("kind"), F.col(id_col).alias("ref")))
    if ids:
        w = Window.partitionBy("result_id", "rule_id", "value").orderBy("item")
        second = reduce(DataFrame.unionByName, ids).withColumn("nth", F.row_number().over(w)).where("nth = 2")
        first = second.groupBy("result_id", "rule_id").agg(F.min_by(F.struct("value", *order), "item").alias("v"))
        out.append(first.select("result_id", "rule_id", "v.*"))
    if refs:
        missing = reduce(DataFrame.unionByName, refs).join(
            reduce(DataFrame.unionByName, known), ["result_id", "kind", "ref"], "left_anti"
        )
        out.append(missing.select("result_id", "rule_id", "value", *order))
    if not out:
        spark = next(iter(relations.values())).sparkSession
        kinds = "result_id string, rule_id string, value string, phase int, item bigint, sub int, sub_pos int"
        return spark.createDataFrame([], kinds)
    return reduce(DataFrame.unionByName, out)


def first_violations(relations: Relations) -> DataFrame:
    """Per graph the violation that a fail-fast check would report."""
    order = F.struct("phase", "item", "sub", "sub_pos")
    return (
        graph_violations(relations).groupBy("result_id")
        .agg(F.min_by(F.struct("rule_id", "value"), order).alias("v"))
        .select("result_id", "v.rule_id", "v.value")
    )


def violation_summary(relations: Relations) -> DataFrame:
    """Counts per rule, with a total (``rule_id`` null)."""
    return graph_violations(relations).rollup("rule_id").agg(F.count("*").alias("n"))


def valid_results(relations: Relations) -> DataFrame:
    """Results without any graph violation."""
    bad = graph_violations(relations).select("result_id").distinct()
    return relations["results"].join(bad, "result_id", "left_anti")


def all_row_violations(relations: Relations) -> DataFrame:
    """Row violations of all relations."""
    with_rules = {r.relation for r in RULES}
    return reduce(
        DataFrame.unionByName, [row_violations(k, df) for k, df in sorted(relations.items()) if k in with_rules]
    )


def check(relations: Relations) -> None:
    """Raise on the first kind of violation, as constructors would: zone
    and row rules (requests first), then the graph's."""
    zones = zone_violations(relations)
    if zones:
        raise ContractViolation(f"time columns without zone: {zones}")
    if "requests" in relations:
        bad = row_violations("requests", relations["requests"]).limit(5).collect()
        if bad:
            raise InvalidRequest(f"invalid requests: {bad}")
    bad = all_row_violations(relations).limit(5).collect()
    if bad:
        raise ContractViolation("rows break rules", rows=bad)
    bad = first_violations(relations).limit(5).collect()
    if bad:
        raise ContractViolation("graphs break rules", rows=bad)
