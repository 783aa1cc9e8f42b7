"""Built-in analysis stages: plain rules on frames, no model behind them.

Each class fits one of the protocols in ``sources.providers``; an engine
takes any mixture of these and a caller's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import blank, strip
from claimloom.operators import claims as claim_rules
from claimloom.operators import conflicts, gaps, render

_NUMBER = r"[0-9]+(?:\.[0-9]+)?"


def _key(prefix: str, *cols: str):
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x1f", *cols), 256), 1, 16))


def _place(df: DataFrame, id_col: str) -> DataFrame:
    w = Window.partitionBy("result_id").orderBy(id_col)
    return df.withColumn("pos", (F.row_number().over(w) - 1).cast("bigint"))


class SentenceClaims:
    """A claim for every distinct sentence or line of a result's evidence."""

    def extract(self, evidence: DataFrame, requests: DataFrame) -> DataFrame:
        """Claims with the evidence that holds them; the status counts
        publishers (sources, where evidence has none)."""
        publisher = F.col("publisher") if "publisher" in evidence.columns else F.col("source_id")
        web = F.col("source_type") == "web" if "source_type" in evidence.columns else F.lit(False)
        parts = evidence.select(
            "result_id", "evidence_id", publisher.alias("publisher"), web.alias("web"),
            F.explode(F.split("content", r"(?<=[.!?])\s+|\n+")).alias("statement"),
        ).withColumn("statement", strip("statement")).where(~blank("statement"))
        found = parts.groupBy("result_id", "statement").agg(
            F.array_sort(F.collect_set("evidence_id")).alias("supporting_evidence_ids"),
            F.count_distinct("publisher").alias("n_publishers"), F.bool_and("web").alias("only_web"),
        )
        return _place(found.select(
            "result_id", _key("c-", "statement").alias("claim_id"), "statement", F.lit("factual").alias("claim_type"),
            "supporting_evidence_ids", F.array().cast("array<string>").alias("conflicting_evidence_ids"),
            F.least(F.lit(1.0), F.col("n_publishers") / claim_rules.INDEPENDENT).alias("confidence"),
            claim_rules.status(F.col("n_publishers"), F.lit(0), F.col("only_web")).alias("status"),
        ), "claim_id")


class NumberConflicts:
    """Claims that differ in a number only, each against the lowest one."""

    def detect(self, claims: DataFrame, evidence: DataFrame, requests: DataFrame) -> DataFrame:
        """Contradictions of two claims each: a linear number of them."""
        numbers = F.regexp_extract_all("statement", F.lit(_NUMBER), F.lit(0))
        valued = claims.where(F.size(numbers) == 1).select(
            "result_id", "claim_id", F.col("result_id").alias("subject"),
            F.regexp_replace("statement", _NUMBER, "#").alias("attribute"), F.try_element_at(numbers, F.lit(1)).cast("double").alias("value"),
        )
        pairs = conflicts.numeric_pairs(valued.drop("result_id"))
        spread = conflicts.numeric(valued).select("subject", "attribute", "severity", "low", "high")
        found = pairs.join(spread, ["subject", "attribute"])
        return _place(found.select(
            F.col("subject").alias("result_id"), _key("x-", "claim_id", "other_id").alias("contradiction_id"),
            F.lit("numeric").alias("contradiction_type"),
            F.concat(F.lit("values from "), F.col("low").cast("string"), F.lit(" to "), F.col("high").cast("string")).alias("description"),
            F.array("other_id", "claim_id").alias("claim_ids"), F.array().cast("array<string>").alias("evidence_ids"),
            "severity", F.lit("unresolved").alias("resolution_status"),
        ), "contradiction_id")


class FactGaps:
    """Gaps of every request, those without any evidence first of all."""

    def analyze(self, claims: DataFrame, evidence: DataFrame, contradictions: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Gaps and open questions; requests without rows count zero."""
        of = lambda df, *aggs: df.groupBy("result_id").agg(*aggs)
        if "source_id" in evidence.columns:
            ev = of(evidence, F.count("*").alias("n_evidence"), F.count_distinct("source_id").alias("n_sources"))
        else:
            ev = of(evidence, F.count("*").alias("n_evidence"), F.lit(0).alias("n_sources"))
        facts = (
            requests.select("result_id").distinct().join(ev, "result_id", "left")
            .join(of(contradictions, F.count("*").alias("n_conflicts")), "result_id", "left")
            .join(of(claims, F.count("*").alias("n_claims")), "result_id", "left").na.fill(0)
        )
        null = lambda kind: F.lit(None).cast(kind)
        facts = facts.select(
            F.col("result_id").alias("subject"), "n_sources", "n_evidence", "n_conflicts",
            F.when(F.col("n_claims") > 0, 1).otherwise(0).alias("n_dimensions"), F.lit(1).alias("n_expected"),
            null("double").alias("authority"), null("double").alias("confidence"), null("int").alias("age_days"),
        )
        found = gaps.gaps(facts)
        asked = gaps.open_questions(found)
        g = _place(found.select(
            F.col("subject").alias("result_id"), F.concat(F.lit("g-"), "condition").alias("gap_id"), "gap_type",
            F.translate("condition", "_", " ").alias("description"), "severity",
        ), "gap_id")
        return g, _place(asked.select(F.col("subject").alias("result_id"), "question", "priority"), "question")


class CountSynthesis:
    """A narrative of how many claims have which status."""

    def synthesize(self, relations: dict[str, DataFrame]) -> DataFrame:
        """One row a result with claims, its sentences in order of status."""
        counts = relations["claims"].groupBy("result_id", "status").agg(F.count("*").alias("n"))
        line = F.concat(F.col("n").cast("string"), F.lit(" claims are "), F.translate("status", "_", " "), F.lit("."))
        said = counts.groupBy("result_id").agg(F.array_sort(F.collect_list(F.struct("status", line.alias("line")))).alias("s"))
        lines = F.transform("s", lambda x: x["line"])  # five statuses at most
        return said.select("result_id", F.lit(0).cast("bigint").alias("pos"), F.array_join(lines, " ").alias("narrative"), lines.alias("key_findings"))


class Markdown:
    """Markdown lines of a result, in order."""

    def render(self, relations: dict[str, DataFrame]) -> DataFrame:
        """``result_id, place, line``; rows, since results may be large."""
        return render.document(relations).orderBy("result_id", "place")
