"""Template synthesis and Markdown; neither alters a result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def findings(claims: DataFrame) -> DataFrame:
    """A sentence per status with the number of claims, and a digest of
    their ids in order (short ones padded, so that numbers sort)."""
    key = F.col("claim_id").cast("string")
    key = F.when(F.char_length(key) < 12, F.lpad(key, 12, "0")).otherwise(key)
    return claims.groupBy("status").agg(
        F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(key)), ",").alias("ids"),
    ).select(
        "status", "n",
        F.concat(F.col("n").cast("string"), F.lit(" claims are "), F.translate("status", "_", " "), F.lit(".")).alias("finding"),
        F.md5("ids").alias("ids_md5"),
    )


def markdown(claims: DataFrame) -> DataFrame:
    """One line of Markdown per claim, in sections by status."""
    return claims.select(
        F.concat(F.lit("## "), F.initcap(F.translate("status", "_", " "))).alias("section"),
        F.concat(F.lit("- "), F.col("claim_id").cast("string"), F.lit(" ("), F.col("n_publishers").cast("string"),
                 F.lit(" publishers)")).alias("line"),
    )


def document(relations: dict[str, DataFrame]) -> DataFrame:
    """Markdown of each result, line by line: ``result_id, place, line``
    in the order of ``result_id, place``.

    One branch per section, rows stay rows: a result of any size renders
    without being gathered.  Relations that are absent have no section.
    """
    out = []

    def add(name: str, section: int, title: str, line, key: str) -> None:
        if name in relations:
            df = relations[name]
            df = df if "pos" in df.columns else df.withColumn("pos", F.lit(0))
            out.append(df.select("result_id", F.lit(section).alias("section"), F.lit(-1).cast("bigint").alias("pos"),
                                 F.lit("").alias("key"), F.lit(f"## {title}").alias("line")).distinct())
            out.append(df.select("result_id", F.lit(section).alias("section"), F.col("pos").cast("bigint").alias("pos"),
                                 F.col(key).cast("string").alias("key"), line.alias("line")))

    c = F.col
    results = relations["results"]
    out.append(results.select("result_id", F.lit(0).alias("section"), F.lit(0).cast("bigint").alias("pos"), F.lit("").alias("key"),
                              F.concat(F.lit("# Result "), "result_id", F.lit(" ("), "status", F.lit(")")).alias("line")))
    add("syntheses", 1, "Synthesis", c("narrative"), "narrative")
    add("claims", 2, "Claims", F.concat(F.lit("- "), "statement", F.lit(" ["), "claim_id", F.lit("] "), F.translate("status", "_", " ")), "claim_id")
    add("contradictions", 3, "Contradictions", F.concat(F.lit("- "), "description", F.lit(" ("), "severity", F.lit("): "), F.array_join("claim_ids", ", ")), "contradiction_id")
    add("gaps", 4, "Gaps", F.concat(F.lit("- "), "description", F.lit(" ("), "severity", F.lit(")")), "gap_id")
    add("open_questions", 5, "Open questions", F.concat(F.lit("- "), "question"), "question")
    add("evidence", 6, "Sources", F.concat(F.lit("- "), "evidence_id", F.lit(": "), "source_id"), "evidence_id")
    lines = out[0]
    for x in out[1:]:
        lines = lines.unionByName(x)
    return lines.select("result_id", F.struct("section", "pos", "key").alias("place"), "line")
