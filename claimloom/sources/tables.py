"""Tables as relations of evidence graphs, and relations on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder (columns and filters are pushed down)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_relations(relations: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """One folder per relation; ``parquet``, ``orc`` or ``json``."""
    for name, df in relations.items():
        df.write.mode("overwrite").format(fmt).save(f"{folder}/{name}")


def read_relations(spark: SparkSession, folder: str, names: list[str], fmt: str = "parquet") -> dict[str, DataFrame]:
    """What ``write_relations`` wrote; JSON is read by its schema."""
    from claimloom.schema import schema_of

    out = {}
    for n in names:
        reader = spark.read.format(fmt)
        out[n] = (reader.schema(schema_of(n)) if fmt == "json" else reader).load(f"{folder}/{n}")
    return out


def knowledge_sources(docs: DataFrame) -> DataFrame:
    """One source per document."""
    key = F.col("doc_id").cast("string")
    return docs.select(
        F.concat(F.lit("doc:"), key).alias("source_id"), F.lit("knowledge").alias("source_type"),
        key.alias("document_id"), F.col("source").alias("publisher"),
    )


def line_evidence(docs: DataFrame) -> DataFrame:
    """One piece of evidence per line that is not blank."""
    from claimloom.functions import blank

    key = F.col("doc_id").cast("string")
    lines = docs.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    return lines.where(~blank("content")).select(
        F.concat(F.lit("doc:"), key, F.lit("#"), F.col("line").cast("string")).alias("evidence_id"),
        F.concat(F.lit("doc:"), key).alias("source_id"), F.col("source").alias("publisher"), "content",
        F.concat(F.lit("line "), F.col("line").cast("string")).alias("locator"),
    )


def order_graphs(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Orders as results, their lines as the members of the graph.

    A deterministic stress model for the validators: the star tables'
    repeated line numbers and skipped lines become duplicate and dangling
    ids.
    """
    o = table(spark, folder, "orders")
    results = o.select(
        F.col("o_orderkey").cast("string").alias("result_id"), F.lit(0).cast("bigint").alias("pos"),
        F.when(F.col("o_orderstatus") == "F", "complete").otherwise("partial").alias("status"),
    )
    li = table(spark, folder, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"
    )
    li = li.withColumn("pos", F.row_number().over(w).cast("bigint"))
    s = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    c = F.col
    key = c("l_orderkey").cast("string").alias("result_id")
    number, part = c("l_linenumber"), c("l_partkey")
    sources = li.where("l_returnflag <> 'R'").select(key, "pos", s("s", c("l_suppkey")).alias("source_id"))
    evidence = li.select(
        key, "pos", s("e", part).alias("evidence_id"),
        F.when(c("l_quantity") < 2, F.lit("  ")).otherwise(s("line ", c("pos"))).alias("content"),
        s("s", c("l_suppkey")).alias("source_id"),
        F.struct(s("s", c("l_suppkey")).alias("source_id"), (number - 2).cast("bigint").alias("retrieval_rank"),
                 (c("l_tax") * 15).alias("retrieval_score")).alias("provenance"),
        F.struct((c("l_discount") * 11).alias("relevance")).alias("quality"),
        F.array(
            F.struct(s("c", number).alias("claim_id"), (c("l_quantity") / 40).alias("confidence")),
            F.struct(s("c", number + 1).alias("claim_id"), F.lit(0.5).alias("confidence")),
        ).alias("claim_links"),
    )
    none = F.array().cast("array<string>")
    claims = li.where("l_linestatus = 'O'").select(
        key, "pos", s("c", number).alias("claim_id"),
        F.when(c("l_quantity") > 49, F.lit("\t")).otherwise(s("claim ", number)).alias("statement"),
        (c("l_discount") * 12).alias("confidence"), F.array(s("e", part)).alias("supporting_evidence_ids"),
        F.when(c("l_discount") > 0.05, F.array(s("e", part + 1))).otherwise(none).alias("conflicting_evidence_ids"),
    )
    contradictions = li.where("l_tax >= 0.06").select(
        key, "pos", s("x", number).alias("contradiction_id"), F.lit("numeric").alias("contradiction_type"),
        s("values of ", number).alias("description"), F.array(s("c", number)).alias("claim_ids"),
        F.when(c("l_quantity") > 25, F.array(s("e", part))).otherwise(none).alias("evidence_ids"),
    )
    gaps = li.where("l_discount >= 0.08").select(
        key, "pos", s("g", number).alias("gap_id"), s("gap ", number).alias("description"),
        F.array(s("c", number)).alias("related_claim_ids"), F.array(s("e", part)).alias("related_evidence_ids"),
    )
    questions = li.where("l_discount < 0.02").select(
        key, "pos", s("Why is line ", number).alias("question"), F.array(s("c", number)).alias("related_claim_ids"),
        F.array(s("g", number)).alias("related_gap_ids"),
    )
    return {
        "results": results, "sources": sources, "evidence": evidence, "claims": claims,
        "contradictions": contradictions, "gaps": gaps, "open_questions": questions,
    }


def trace_of_events(events: DataFrame) -> DataFrame:
    """The event table as trace events."""
    stage = F.create_map(*(
        F.lit(x) for x in ("click", "retrieval", "view", "extraction", "purchase", "synthesis", "signup", "init", "error", "other")
    ))
    return events.select(
        F.col("user_id").cast("string").alias("result_id"), F.col("event_id").alias("pos"),
        F.concat(F.lit("evt-"), F.col("event_id").cast("string")).alias("event_id"),
        stage[F.col("event_type")].alias("stage"),
        F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"),
        F.col("event_type").alias("message"), F.col("ts").alias("occurred_at"),
        F.when(F.col("event_type") != "view", F.col("value")).alias("duration_ms"), F.col("props").alias("payload"),
    )


def _mod(m: int, *cases: str, rest: str) -> str:
    """SQL (Spark's and others') that picks a value by the part's key."""
    return "CASE " + " ".join(f"WHEN l_partkey % {m} = {k} THEN {v}" for k, v in enumerate(cases)) + f" ELSE {rest} END"


def _text(m: int) -> str:
    return _mod(m, "concat(chr(160), ' ')", rest="concat('x', CAST(l_partkey AS STRING))")


def _share(m: int) -> str:
    return "CAST(" + _mod(m, "1.5", "-0.1", "'NaN'", "NULL", "0", rest="1").replace("1.5", "'1.5'").replace("-0.1", "'-0.1'").replace(
        "THEN 0", "THEN '0'").replace("ELSE 1", "ELSE '1'") + " AS DOUBLE)"


#: Scalar columns, by relation, of graphs in which every row rule breaks
#: somewhere; the expressions read alike in Spark's SQL and in others.
BROKEN: dict[str, dict[str, str]] = {
    "requests": {
        "question": _text(11), "profile": _text(13), "max_knowledge_results": _mod(17, "0", "-1", rest="5"),
        "max_web_results": _mod(19, "0", "-1", rest="5"), "max_web_pages": _mod(23, "0", "-1", rest="5"),
    },
    "sources": {"source_id": _text(11)},
    "evidence": {
        "evidence_id": _text(13), "content": _text(17), "source_id": _text(19), "provenance_source_id": _text(23),
        "retrieval_rank": _mod(29, "-1", "NULL", rest="0"), "retrieval_score": _share(31), "provenance_confidence": _share(37),
        "relevance": _share(41), "authority": _share(43), "recency": _share(47), "quality_confidence": _share(53),
        "link_claim_id": _text(59), "link_confidence": _share(61),
    },
    "claims": {"claim_id": _text(11), "statement": _text(13), "confidence": _share(17)},
    "contradictions": {"contradiction_id": _text(11), "description": _text(13), "n_claims": _mod(17, "0", "1", rest="2"),
                       "n_evidence": _mod(19, "0", "1", rest="2")},
    "gaps": {"gap_id": _text(11), "description": _text(13)},
    "open_questions": {"question": _text(11)},
    "dimensions": {"score": _share(11)},
    "diagnostics": {"composite": _share(13)},
    "trace_events": {"event_id": _text(11), "message": _text(13),
                     "duration_ms": "CAST(" + _mod(17, "'-1'", "'NaN'", "NULL", rest="'0'") + " AS DOUBLE)"},
    "syntheses": {"narrative": _text(11), "confidence": _share(13)},
}


def broken_graphs(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Lines of orders as members of every relation, with the columns of
    ``BROKEN`` nested as the relations have them."""
    li = table(spark, folder, "lineitem")
    c = F.col
    flat = {
        name: li.select(
            c("l_orderkey").cast("string").alias("result_id"), c("l_linenumber").cast("bigint").alias("pos"),
            *(F.expr(sql).alias(k) for k, sql in columns.items()),
        )
        for name, columns in BROKEN.items()
    }
    ids = lambda n: F.transform(F.slice(F.array(F.lit(1), F.lit(2)), 1, c(n)), lambda i: F.concat(F.lit("x"), i.cast("string")))
    out = dict(flat)
    out["requests"] = flat["requests"].withColumn("profiles", F.array(F.lit("p"), c("profile"))).drop("profile")
    out["evidence"] = flat["evidence"].select(
        "result_id", "pos", "evidence_id", "content", "source_id",
        F.struct(c("provenance_source_id").alias("source_id"), "retrieval_rank", "retrieval_score",
                 c("provenance_confidence").alias("extraction_confidence")).alias("provenance"),
        F.struct("relevance", "authority", "recency", c("quality_confidence").alias("extraction_confidence")).alias("quality"),
        F.array(F.struct(F.lit("c").alias("claim_id"), F.lit(0.5).alias("confidence")),
                F.struct(c("link_claim_id").alias("claim_id"), c("link_confidence").alias("confidence"))).alias("claim_links"),
    )
    out["contradictions"] = flat["contradictions"].select(
        "result_id", "pos", "contradiction_id", "description", ids("n_claims").alias("claim_ids"), ids("n_evidence").alias("evidence_ids")
    )
    return out


def timed_graphs(spark: SparkSession, folder: str, zone: bool) -> dict[str, DataFrame]:
    """Relations with the time columns that must have a zone, with or
    without one."""
    kind = "timestamp" if zone else "timestamp_ntz"
    o = table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("result_id"), F.lit(0).cast("bigint").alias("pos"), F.col("o_orderdate").cast(kind).alias("t")
    )
    return {
        "evidence": o.select("result_id", "pos", F.struct(F.col("t").alias("retrieved_at")).alias("provenance"), F.col("t").alias("observed_at")),
        "trace_events": o.select("result_id", "pos", F.col("t").alias("occurred_at")),
        "syntheses": o.select("result_id", "pos", F.col("t").alias("synthesized_at")),
        "results": o.select("result_id", "pos", F.col("t").alias("completed_at")),
    }
