"""Registered queries of the engine, each beside its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.functions import WHITESPACE, digest, iso_date, iso_local
from claimloom.functions.serialize import to_json
from claimloom.operators import accessors, claims, conflicts, gaps, normalize, quality, rank, render, retrieve, trace, validate
from claimloom.operators.rules import domain_violations, row_violations, zone_violations
from claimloom.plans import engine
from claimloom.schema import DIMENSIONS, LOWER_IS_BETTER
from claimloom.sources import tables
from claimloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and its SQL."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


WS = "concat(" + ", ".join(f"chr({ord(c)})" for c in WHITESPACE) + ")"

# --- the order graphs of sources.tables, as SQL ---------------------------
LI = """li AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
    l_extendedprice, l_discount, l_tax, l_shipdate) AS pos, CAST(l_orderkey AS VARCHAR) AS result_id FROM lineitem)"""
GRAPH = f"""WITH {LI},
results AS (SELECT CAST(o_orderkey AS VARCHAR) AS result_id, CASE WHEN o_orderstatus = 'F' THEN 'complete' ELSE 'partial' END AS status FROM orders),
sources AS (SELECT result_id, pos, 's' || l_suppkey AS source_id FROM li WHERE l_returnflag <> 'R'),
evidence AS (SELECT result_id, pos, 'e' || l_partkey AS evidence_id, 's' || l_suppkey AS source_id,
  CASE WHEN l_quantity < 2 THEN '  ' ELSE 'line ' || pos END AS content, l_linenumber - 2 AS retrieval_rank,
  l_tax * 15 AS retrieval_score, l_discount * 11 AS relevance, l_quantity / 40 AS link_confidence,
  ['c' || l_linenumber, 'c' || (l_linenumber + 1)] AS links FROM li),
claims AS (SELECT result_id, pos, 'c' || l_linenumber AS claim_id, l_discount * 12 AS confidence,
  CASE WHEN l_quantity > 49 THEN chr(9) ELSE 'claim ' || l_linenumber END AS statement, ['e' || l_partkey] AS supporting,
  CASE WHEN l_discount > 0.05 THEN ['e' || (l_partkey + 1)] ELSE [] END AS conflicting FROM li WHERE l_linestatus = 'O'),
contradictions AS (SELECT result_id, pos, 'x' || l_linenumber AS contradiction_id, ['c' || l_linenumber] AS claim_ids,
  CASE WHEN l_quantity > 25 THEN ['e' || l_partkey] ELSE [] END AS evidence_ids FROM li WHERE l_tax >= 0.06),
gaps AS (SELECT result_id, pos, 'g' || l_linenumber AS gap_id, ['c' || l_linenumber] AS claim_ids,
  ['e' || l_partkey] AS evidence_ids FROM li WHERE l_discount >= 0.08),
questions AS (SELECT result_id, pos, 'Why is line ' || l_linenumber AS question, ['c' || l_linenumber] AS claim_ids,
  ['g' || l_linenumber] AS gap_ids FROM li WHERE l_discount < 0.02)
"""


def _arr_ref(rule: str, holder: str, name: str, arr: str, target: str, target_id: str) -> str:
    return f"""SELECT result_id, pos, holder, ref_pos, ref FROM (
  SELECT result_id, pos, {name} AS holder, CAST(i - 1 AS INTEGER) AS ref_pos, {arr}[i] AS ref FROM (
    SELECT *, unnest(range(1, len({arr}) + 1)) AS i FROM {holder})) r
WHERE NOT EXISTS (SELECT 1 FROM {target} t WHERE t.result_id = r.result_id AND t.{target_id} = r.ref)"""


REF_SQL = {
    "R01": """SELECT result_id, pos, evidence_id AS holder, CAST(0 AS INTEGER) AS ref_pos, source_id AS ref FROM evidence r
WHERE NOT EXISTS (SELECT 1 FROM sources t WHERE t.result_id = r.result_id AND t.source_id = r.source_id)""",
    "R02": _arr_ref("R02", "evidence", "evidence_id", "links", "claims", "claim_id"),
    "R03": _arr_ref("R03", "claims", "claim_id", "supporting", "evidence", "evidence_id"),
    "R04": _arr_ref("R04", "claims", "claim_id", "conflicting", "evidence", "evidence_id"),
    "R05": _arr_ref("R05", "contradictions", "contradiction_id", "claim_ids", "claims", "claim_id"),
    "R06": _arr_ref("R06", "contradictions", "contradiction_id", "evidence_ids", "evidence", "evidence_id"),
    "R07": _arr_ref("R07", "gaps", "gap_id", "claim_ids", "claims", "claim_id"),
    "R08": _arr_ref("R08", "gaps", "gap_id", "evidence_ids", "evidence", "evidence_id"),
    "R09": _arr_ref("R09", "questions", "substr(question, 1, 40)", "claim_ids", "claims", "claim_id"),
    "R10": _arr_ref("R10", "questions", "substr(question, 1, 40)", "gap_ids", "gaps", "gap_id"),
}
FIRST_DUP = """SELECT result_id, '{u}' AS rule_id, arg_min(id, pos) AS value, {p} AS phase, min(pos) AS item, 0 AS sub, 0 AS sub_pos
FROM (SELECT result_id, pos, {c} AS id, row_number() OVER (PARTITION BY result_id, {c} ORDER BY pos) AS nth FROM {t}) WHERE nth = 2 GROUP BY result_id"""
NO_SOURCES = """SELECT result_id FROM results r WHERE status = 'complete'
AND NOT EXISTS (SELECT 1 FROM sources s WHERE s.result_id = r.result_id)"""
ALL_GRAPH = "violations AS (\n" + "\nUNION ALL\n".join(
    [f"SELECT result_id, 'C01' AS rule_id, '' AS value, 1 AS phase, 0 AS item, 0 AS sub, 0 AS sub_pos FROM ({NO_SOURCES})"]
    + [FIRST_DUP.format(u=u, p=p, c=c, t=t) for u, t, c, p in validate.UNIQUE]
    + [f"SELECT result_id, '{r[0]}', holder || ' -> ' || ref, {r[6]}, pos, {r[7]}, ref_pos FROM ({REF_SQL[r[0]]})" for r in validate.REFERENCES]
) + ")\n"
GRAPH_ALL = GRAPH.rstrip() + ",\n" + ALL_GRAPH


# --- requests ---------------------------------------------------------------
def _requests(spark: SparkSession, d: str) -> DataFrame:
    """User turns as requests; their words as profiles."""
    turns = table(spark, d, "conversations").where("role = 'user'")
    return turns.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("result_id"),
        F.col("turn").alias("pos"), F.concat(F.lit("  "), F.col("text"), F.lit("\n")).alias("question"),
        F.split("text", " ").alias("profiles"),
        (F.col("turn") % 4).alias("max_knowledge_results"), (F.col("conv_id") % 3).alias("max_web_results"),
        F.lit(5).cast("bigint").alias("max_web_pages"),
        F.when(F.col("conv_id") % 2 == 0, F.lit("de")).otherwise(F.lit("en")).alias("language"),
    )


REQ = """WITH requests AS (SELECT conv_id || '-' || turn AS result_id, turn AS pos, ' ' || chr(160) || text || chr(10) AS question,
  string_split(text, ' ') AS profiles, turn % 4 AS max_knowledge_results, conv_id % 3 AS max_web_results,
  CAST(5 AS BIGINT) AS max_web_pages, CASE WHEN conv_id % 2 = 0 THEN 'de' ELSE 'en' END AS language
  FROM conversations WHERE role = 'user')
"""


@query("request_normalize", REQ + f"SELECT result_id, trim(question, {WS}) AS question FROM requests")
def request_normalize(spark, d):
    return normalize.normalise_requests(_requests(spark, d)).select("result_id", "question")


@query("profiles_dedup", REQ + f""", p AS (SELECT result_id, list_transform(profiles, lambda x: trim(x, {WS})) AS l FROM requests)
SELECT result_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS profiles FROM p""")
def profiles_dedup(spark, d):
    return normalize.normalise_requests(_requests(spark, d)).select("result_id", F.array_join("profiles", "|").alias("profiles"))


@query("request_rules", REQ + f"""SELECT result_id, pos, rule_id FROM (
SELECT result_id, pos, 'V01' AS rule_id FROM requests WHERE trim(question, {WS}) = '' UNION ALL
SELECT result_id, pos, 'V02' FROM requests WHERE len(list_filter(profiles, lambda x: trim(x, {WS}) = '')) > 0 UNION ALL
SELECT result_id, pos, 'V03' FROM requests WHERE NOT max_knowledge_results > 0 UNION ALL
SELECT result_id, pos, 'V04' FROM requests WHERE NOT max_web_results > 0 UNION ALL
SELECT result_id, pos, 'V05' FROM requests WHERE NOT max_web_pages > 0)""")
def request_rules(spark, d):
    return row_violations("requests", _requests(spark, d)).select("result_id", "pos", "rule_id")


@query("has_profiles", REQ + "SELECT result_id, len(profiles) > 0 AS has_profiles FROM requests")
def has_profiles(spark, d):
    return accessors.has_profiles(_requests(spark, d)).select("result_id", "has_profiles")


@query("effective_limits", REQ + """, o AS (SELECT conv_id || '-' || turn AS result_id, CASE WHEN turn % 3 = 0 THEN 'web' ELSE 'knowledge' END AS kind,
  CASE WHEN conv_id % 5 = 0 THEN NULL ELSE conv_id % 5 - 1 END AS max_results, CASE WHEN conv_id % 2 = 0 THEN turn END AS max_pages,
  CASE WHEN turn % 2 = 0 THEN '' END AS language FROM conversations WHERE role = 'user')
SELECT o.result_id, kind, coalesce(o.max_results, CASE WHEN kind = 'web' THEN r.max_web_results ELSE r.max_knowledge_results END) AS effective_max_results,
  coalesce(o.max_pages, r.max_web_pages) AS effective_max_pages, coalesce(o.language, r.language) AS effective_language
FROM o JOIN requests r USING (result_id)""")
def effective_limits(spark, d):
    turns = table(spark, d, "conversations").where("role = 'user'")
    o = turns.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("result_id"),
        F.when(F.col("turn") % 3 == 0, "web").otherwise("knowledge").alias("kind"),
        F.when(F.col("conv_id") % 5 != 0, F.col("conv_id") % 5 - 1).alias("max_results"),
        F.when(F.col("conv_id") % 2 == 0, F.col("turn")).alias("max_pages"),
        F.when(F.col("turn") % 2 == 0, F.lit("")).alias("language"),
    )
    return accessors.effective_limits(o, _requests(spark, d)).select(
        "result_id", "kind", "effective_max_results", "effective_max_pages", "effective_language"
    )


PROFILES = "profiles AS (SELECT n_name AS profile_id, 'region ' || n_regionkey AS config FROM nation WHERE n_nationkey % 5 <> 0)"
ASKED = """asked AS (SELECT c_mktsegment || '-' || c_custkey AS result_id, unnest([0, 1]) AS pos, unnest([a.n_name, b.n_name]) AS profile_id
  FROM customer JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_nationkey = (c_nationkey + 7) % 25)"""


def _asked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = table(spark, d, "nation")
    a = n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("a"))
    b = n.select(((F.col("n_nationkey") + 18) % 25).alias("c_nationkey"), F.col("n_name").alias("b"))
    asked = table(spark, d, "customer").join(F.broadcast(a), "c_nationkey").join(F.broadcast(b), "c_nationkey").select(
        F.concat_ws("-", "c_mktsegment", F.col("c_custkey").cast("string")).alias("result_id"), F.array("a", "b").alias("profiles")
    )
    known = n.where("n_nationkey % 5 <> 0").select(
        F.col("n_name").alias("profile_id"), F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("config")
    )
    return asked, known


@query("profile_resolve", f"WITH {PROFILES}, {ASKED} SELECT result_id, CAST(pos AS INTEGER) AS pos, profile_id, config FROM asked JOIN profiles USING (profile_id)")
def profile_resolve(spark, d):
    return accessors.resolve_profiles(*_asked(spark, d)).select("result_id", "pos", "profile_id", "config")


@query("profile_unknown", f"""WITH {PROFILES}, {ASKED} SELECT result_id, CAST(pos AS INTEGER) AS pos, profile_id FROM asked a
WHERE NOT EXISTS (SELECT 1 FROM profiles p WHERE p.profile_id = a.profile_id)""")
def profile_unknown(spark, d):
    return accessors.unknown_profiles(*_asked(spark, d))


# --- row rules ---------------------------------------------------------------
def _rows(spark: SparkSession, d: str, relations: list[str], rules: tuple[str, ...]) -> DataFrame:
    g = tables.order_graphs(spark, d)
    out = None
    for r in relations:
        v = row_violations(r, g[r], rules)
        out = v if out is None else out.unionByName(v)
    return out.select("result_id", "relation", "pos", "rule_id")


@query("rule_blank_ids", GRAPH + f"""SELECT result_id, 'evidence' AS relation, pos, 'V19' AS rule_id FROM evidence WHERE trim(content, {WS}) = ''
UNION ALL SELECT result_id, 'claims', pos, 'V23' FROM claims WHERE trim(statement, {WS}) = ''""")
def rule_blank_ids(spark, d):
    return _rows(spark, d, ["sources", "evidence", "claims", "contradictions", "gaps", "open_questions"],
                 ("V06", "V07", "V16", "V18", "V19", "V20", "V22", "V23", "V25", "V26", "V28", "V29", "V30"))


@query("rule_unit_scores", GRAPH + """SELECT result_id, 'evidence' AS relation, pos, 'V10' AS rule_id FROM evidence WHERE NOT retrieval_score BETWEEN 0 AND 1
UNION ALL SELECT result_id, 'evidence', pos, 'V12' FROM evidence WHERE NOT relevance BETWEEN 0 AND 1
UNION ALL SELECT result_id, 'evidence', pos, 'V17' FROM evidence WHERE NOT link_confidence BETWEEN 0 AND 1
UNION ALL SELECT result_id, 'claims', pos, 'V24' FROM claims WHERE NOT confidence BETWEEN 0 AND 1""")
def rule_unit_scores(spark, d):
    return _rows(spark, d, ["evidence", "claims"], ("V10", "V11", "V12", "V13", "V14", "V15", "V17", "V24"))


@query("rule_min_refs", GRAPH + "SELECT result_id, 'contradictions' AS relation, pos, 'V27' AS rule_id FROM contradictions WHERE len(claim_ids) + len(evidence_ids) < 2")
def rule_min_refs(spark, d):
    return _rows(spark, d, ["contradictions"], ("V27",))


@query("rule_nonneg", GRAPH + """SELECT result_id, 'evidence' AS relation, pos, 'V09' AS rule_id FROM evidence WHERE retrieval_rank < 0
UNION ALL SELECT CAST(user_id AS VARCHAR), 'trace_events', event_id, 'V36' FROM events WHERE event_type <> 'view' AND value < 0""")
def rule_nonneg(spark, d):
    events = row_violations("trace_events", tables.trace_of_events(table(spark, d, "events")), ("V36",))
    return _rows(spark, d, ["evidence"], ("V09",)).unionByName(events.select("result_id", "relation", "pos", "rule_id"))


# --- graph constraints -----------------------------------------------------------
@query("dup_ids", GRAPH + "\nUNION ALL\n".join(
    f"SELECT '{u}' AS rule_id, result_id, {c} AS id, count(*) AS n FROM {t} GROUP BY result_id, {c} HAVING count(*) > 1" for u, t, c, _ in validate.UNIQUE))
def dup_ids(spark, d):
    g = tables.order_graphs(spark, d)
    out = None
    for u, t, c, _ in validate.UNIQUE:
        x = validate.duplicates(g[t], c).select(F.lit(u).alias("rule_id"), "result_id", F.col(c).alias("id"), "n")
        out = x if out is None else out.unionByName(x)
    return out


@query("dup_first", GRAPH + "\nUNION ALL\n".join(
    f"SELECT result_id, '{u}' AS rule_id, value AS id, item AS pos FROM ({FIRST_DUP.format(u=u, p=p, c=c, t=t)})" for u, t, c, p in validate.UNIQUE))
def dup_first(spark, d):
    g = tables.order_graphs(spark, d)
    out = None
    for u, t, c, _ in validate.UNIQUE:
        x = validate.first_duplicate(g[t], c).select("result_id", F.lit(u).alias("rule_id"), F.col(c).alias("id"), "pos")
        out = x if out is None else out.unionByName(x)
    return out


def _dangling(name: str, rules: tuple[str, ...]) -> None:
    sql = GRAPH + "\nUNION ALL\n".join(f"SELECT '{r}' AS rule_id, result_id, pos, holder, ref_pos, ref FROM ({REF_SQL[r]})" for r in rules)

    def run(spark: SparkSession, d: str) -> DataFrame:
        g = tables.order_graphs(spark, d)
        out = None
        for r in rules:
            x = validate.dangling(r, g).withColumn("rule_id", F.lit(r))
            out = x if out is None else out.unionByName(x)
        return out

    query(name, sql)(run)


for _name, _rules in (
    ("dangling_evidence_source", ("R01",)), ("dangling_link_claim", ("R02",)), ("dangling_claim_evidence", ("R03", "R04")),
    ("dangling_contradiction", ("R05", "R06")), ("dangling_gap", ("R07", "R08")), ("dangling_question", ("R09", "R10")),
):
    _dangling(_name, _rules)


@query("complete_without_sources", GRAPH + NO_SOURCES)
def complete_without_sources(spark, d):
    return validate.complete_without_sources(tables.order_graphs(spark, d))


@query("first_violation", GRAPH_ALL + """SELECT result_id, v.rule_id AS rule_id, v.value AS value FROM (
SELECT result_id, arg_min({'rule_id': rule_id, 'value': value}, CAST(phase AS BIGINT) * 1000000000000 + item * 1000000 + sub * 100000 + sub_pos) AS v FROM violations GROUP BY result_id)""")
def first_violation(spark, d):
    return validate.first_violations(tables.order_graphs(spark, d))


@query("violation_summary", GRAPH_ALL + "SELECT rule_id, count(*) AS n FROM violations GROUP BY ROLLUP (rule_id)")
def violation_summary(spark, d):
    return validate.violation_summary(tables.order_graphs(spark, d))


@query("results_valid", GRAPH_ALL + """SELECT result_id, status, status = 'complete' AS is_complete, status = 'partial' AS is_partial FROM results r
WHERE NOT EXISTS (SELECT 1 FROM violations v WHERE v.result_id = r.result_id)""")
def results_valid(spark, d):
    return accessors.with_flags(validate.valid_results(tables.order_graphs(spark, d))).select(
        "result_id", "status", "is_complete", "is_partial"
    )


@query("lineage", GRAPH + """SELECT c.result_id, c.claim_id, e.evidence_id, s.source_id, count(*) AS n_paths
FROM (SELECT result_id, claim_id, unnest(supporting) AS evidence_id FROM claims) c
JOIN evidence e ON e.result_id = c.result_id AND e.evidence_id = c.evidence_id
JOIN sources s ON s.result_id = e.result_id AND s.source_id = e.source_id GROUP BY ALL""")
def lineage(spark, d):
    g = tables.order_graphs(spark, d)
    c = g["claims"].select("result_id", "claim_id", F.explode("supporting_evidence_ids").alias("evidence_id"))
    e = g["evidence"].select("result_id", "evidence_id", "source_id")
    s = g["sources"].select("result_id", "source_id")
    return (
        c.join(e, ["result_id", "evidence_id"]).join(s, ["result_id", "source_id"])
        .groupBy("result_id", "claim_id", "evidence_id", "source_id").agg(F.count("*").alias("n_paths"))
    )


# --- traces ------------------------------------------------------------------------
TRACE = """WITH trace AS (SELECT CAST(user_id AS VARCHAR) AS result_id, event_id AS pos, 'evt-' || event_id AS event_id,
  CASE event_type WHEN 'click' THEN 'retrieval' WHEN 'view' THEN 'extraction' WHEN 'purchase' THEN 'synthesis' WHEN 'signup' THEN 'init' WHEN 'error' THEN 'other' END AS stage,
  CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status, CASE WHEN event_type <> 'view' THEN value END AS duration_ms FROM events)
"""


def _trace(spark: SparkSession, d: str) -> DataFrame:
    return tables.trace_of_events(table(spark, d, "events"))


@query("trace_stage", TRACE + "SELECT result_id, pos, event_id FROM trace WHERE stage = 'retrieval'")
def trace_stage(spark, d):
    return accessors.events_of_stage(_trace(spark, d), "retrieval").select("result_id", "pos", "event_id")


@query("trace_failed", TRACE + "SELECT result_id, pos, event_id FROM trace WHERE status = 'failed'")
def trace_failed(spark, d):
    return accessors.failed_events(_trace(spark, d)).select("result_id", "pos", "event_id")


@query("trace_stage_summary", TRACE + "SELECT stage, status, count(*) AS n FROM trace GROUP BY ROLLUP (stage, status)")
def trace_stage_summary(spark, d):
    return trace.stage_summary(_trace(spark, d))


@query("trace_durations", TRACE + """SELECT stage, count(*) AS n, count(duration_ms) AS n_timed, min(duration_ms) AS shortest,
max(duration_ms) AS longest FROM trace GROUP BY stage""")
def trace_durations(spark, d):
    return trace.durations(_trace(spark, d))


# --- serialisation --------------------------------------------------------------------
@query("serialize_claims", GRAPH + """SELECT result_id, pos, '{"claim_id":"' || claim_id || '","supporting_evidence_ids":[' ||
  array_to_string(list_transform(supporting, lambda x: '"' || x || '"'), ',') || '],"conflicting_evidence_ids":[' ||
  array_to_string(list_transform(conflicting, lambda x: '"' || x || '"'), ',') || '],"scope":null}' AS json FROM claims""")
def serialize_claims(spark, d):
    c = tables.order_graphs(spark, d)["claims"].select(
        "result_id", "pos", "claim_id", "supporting_evidence_ids", "conflicting_evidence_ids", F.lit(None).cast("string").alias("scope")
    )
    return c.select("result_id", "pos", to_json(c, "result_id", "pos").alias("json"))


@query("serialize_times", """SELECT o_orderkey AS pos, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') ||
  CASE WHEN microsecond(o_orderdate) % 1000000 = 0 THEN '' ELSE '.' || strftime(o_orderdate, '%f') END || '+00:00' AS iso, strftime(o_orderdate, '%Y-%m-%d') AS iso_date FROM orders""")
def serialize_times(spark, d):
    zone = F.date_format(F.col("o_orderdate"), "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format("o_orderdate", "SSSSSS")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("pos"),
        F.concat(zone, F.when(fraction == "000000", F.lit("")).otherwise(F.concat(F.lit("."), fraction)), F.lit("+00:00")).alias("iso"),
        F.col("o_orderdate").cast("date").cast("string").alias("iso_date"),
    )


# --- retrieval -----------------------------------------------------------------------------
@query("retrieve_topk", """WITH t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}'))) AS term FROM documents),
q AS (SELECT conv_id || '-' || turn AS request_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}'))) AS term FROM conversations WHERE role = 'user'),
h AS (SELECT request_id, doc_id, count(*) AS n_shared FROM q JOIN t USING (term) GROUP BY 1, 2)
SELECT request_id, CAST(rank AS INTEGER) AS rank, doc_id, n_shared FROM (
SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY n_shared DESC, doc_id) AS rank FROM h) WHERE rank <= 10""")
def retrieve_topk(spark, d):
    """The ten best documents by all shared terms, however common."""
    asked = _requests(spark, d).select(F.col("result_id").alias("request_id"), "question")
    return retrieve.retrieve(asked, table(spark, d, "documents"), 10)


@query("retrieve_embedding_topk", """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
q AS (SELECT v.* FROM v JOIN (SELECT label, min(vec_id) AS vec_id FROM v GROUP BY label) USING (label, vec_id)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) /
  (sqrt(list_sum(list_transform(q.e, lambda x: x * x))) * sqrt(list_sum(list_transform(c.e, lambda x: x * x)))), 9) AS score
  FROM v c JOIN q ON q.label = c.label AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(score, 6) AS score FROM (
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def retrieve_embedding_topk(spark, d):
    v = table(spark, d, "embeddings")
    first = v.groupBy("label").agg(F.min("vec_id").alias("vec_id"))  # each cell's query: one row meets it once
    return retrieve.nearest(v.join(first, ["label", "vec_id"]), v, 5).withColumn("score", F.round("score", 6))


PAGE_TEXT = f"""trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g'),
  '(?s)<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'), {WS})"""


@query("web_extract_text", f"SELECT page_id, {PAGE_TEXT} AS content FROM pages")
def web_extract_text(spark, d):
    return table(spark, d, "pages").select("page_id", retrieve.page_text("html").alias("content"))


@query("web_sources", f"""SELECT 'page:' || page_id AS source_id, 'web' AS source_type,
trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), {WS}) AS title, url,
lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) AS publisher FROM pages""")
def web_sources(spark, d):
    return retrieve.web_sources(table(spark, d, "pages"))


@query("web_topk", """SELECT publisher, page_id, CAST(rank AS INTEGER) AS rank FROM (SELECT publisher, page_id, row_number() OVER (PARTITION BY publisher ORDER BY length(html) DESC, page_id) AS rank
FROM (SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) AS publisher, page_id, html FROM pages)) WHERE rank <= 5""")
def web_topk(spark, d):
    p = table(spark, d, "pages").select(retrieve.host("url").alias("publisher"), "page_id", F.char_length("html").alias("size"))
    w = Window.partitionBy("publisher").orderBy(F.col("size").desc(), "page_id")
    return p.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("publisher", "page_id", "rank")


# --- evidence --------------------------------------------------------------------------------
LINES = f"""WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
ev AS (SELECT 'doc:' || doc_id || '#' || line AS evidence_id, 'doc:' || doc_id AS source_id, source AS publisher, content FROM l WHERE trim(content, {WS}) <> '')
"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return tables.line_evidence(table(spark, d, "documents"))


@query("evidence_unified", LINES + f"""SELECT source_type, count(*) AS n, count(DISTINCT source_id) AS n_sources FROM (
SELECT 'knowledge' AS source_type, source_id FROM ev UNION ALL SELECT 'web', 'page:' || page_id FROM pages WHERE {PAGE_TEXT} <> '') GROUP BY 1""")
def evidence_unified(spark, d):
    web = retrieve.web_excerpts(table(spark, d, "pages")).where("content <> ''").withColumn("source_type", F.lit("web"))
    both = normalize.unify(_lines(spark, d).withColumn("source_type", F.lit("knowledge")), web)
    return both.groupBy("source_type").agg(F.count("*").alias("n"), F.count_distinct("source_id").alias("n_sources"))


@query("evidence_dedup", LINES + """SELECT sha256(content) AS content_hash, min(evidence_id) AS evidence_id, count(*) AS n,
count(DISTINCT publisher) AS n_publishers FROM ev GROUP BY 1""")
def evidence_dedup(spark, d):
    return normalize.deduplicate(_lines(spark, d))


QUAL = """q AS (SELECT d.doc_id, d.source, CAST(l.quality AS DOUBLE) AS authority,
  CAST(length(regexp_replace(text, '[^A-Za-z ]', '', 'g')) AS DOUBLE) / nullif(length(text), 0) AS confidence,
  greatest(0.0, least(1.0, 1.0 - CAST(d.doc_id % 400 AS DOUBLE) / CAST(365.0 AS DOUBLE))) AS recency,
  CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE CAST(d.n_chars % 100 AS DOUBLE) / CAST(100 AS DOUBLE) END AS relevance
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def _quality(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("authority"))
    as_of = F.to_date(F.lit("2024-01-01"))
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", "source", "authority", rank.alphabetic_share("text").alias("confidence"),
        rank.recency(F.date_sub(as_of, (F.col("doc_id") % 400).cast("int")), as_of).alias("recency"),
        F.when(F.col("doc_id") % 7 != 0, (F.col("n_chars") % 100).cast("double") / 100).alias("relevance"),
    )


@query("evidence_quality", f"WITH {QUAL} SELECT doc_id, authority, round(confidence, 6) AS confidence, round(recency, 6) AS recency, relevance FROM q")
def evidence_quality(spark, d):
    return _quality(spark, d).select("doc_id", "authority", F.round("confidence", 6).alias("confidence"), F.round("recency", 6).alias("recency"), "relevance")


SCORED = f"""WITH {QUAL}, s AS (SELECT doc_id, source, round((coalesce(relevance * CAST(0.5 AS DOUBLE), 0.0) + coalesce(authority * CAST(0.3 AS DOUBLE), 0.0) + coalesce(recency * CAST(0.2 AS DOUBLE), 0.0)) /
  (CASE WHEN relevance IS NULL THEN CAST(0 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END + CASE WHEN authority IS NULL THEN CAST(0 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END + CAST(0.2 AS DOUBLE)), 6) AS score FROM q),
r AS (SELECT doc_id, source, score, CAST(row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s)
"""


@query("evidence_rank", SCORED + "SELECT doc_id, source, score, rank FROM r")
def evidence_rank(spark, d):
    return rank.rank(_quality(spark, d), "source", "doc_id").select("doc_id", "source", "score", "rank")


@query("evidence_topk_per_source", SCORED + "SELECT doc_id, source, score, rank FROM r WHERE rank <= 3")
def evidence_topk_per_source(spark, d):
    return rank.top(_quality(spark, d), "source", 3, "doc_id").select("doc_id", "source", "score", "rank")


# --- claims -------------------------------------------------------------------------------------
NUM = """nc AS (SELECT CAST(o_orderkey AS VARCHAR) AS subject, 'total' AS attribute, 'order' AS scope, o_totalprice AS value FROM orders
  UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'total', 'lines', sum(CAST(l_extendedprice AS DECIMAL(18, 2))) FROM lineitem GROUP BY l_orderkey)"""


def _numeric(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("subject"), F.lit("total").alias("attribute"), F.lit("order").alias("scope"),
        F.col("o_totalprice").alias("value"),
    )
    # sums in decimals do not depend on the order of rows
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("value")
    )
    li = li.select(F.col("l_orderkey").cast("string").alias("subject"), F.lit("total").alias("attribute"), F.lit("lines").alias("scope"), "value")
    return o.unionByName(li).withColumn("claim_id", F.concat_ws("/", "subject", "scope"))


@query("claims_numeric", f"WITH {NUM} SELECT sha256(subject || '|' || attribute || '|' || scope) AS claim_id, subject, scope, round(value, 2) AS value FROM nc")
def claims_numeric(spark, d):
    return _numeric(spark, d).select(
        digest(F.concat_ws("|", "subject", "attribute", "scope")).alias("claim_id"), "subject", "scope", F.round("value", 2).alias("value")
    )


@query("claims_passage", "SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def claims_passage(spark, d):
    return claims.passages_in(table(spark, d, "documents"), table(spark, d, "benchmark"))


def _corroboration(spark: SparkSession, d: str) -> DataFrame:
    docs, b = table(spark, d, "documents"), table(spark, d, "benchmark")
    return claims.corroboration(claims.passages_in(docs, b), docs, b)


STATUS = "CASE WHEN count(DISTINCT d.source) >= 2 THEN 'supported' WHEN count(DISTINCT d.source) = 1 THEN 'partially_supported' ELSE 'unsupported' END"
CORR = f"""SELECT b.item_id, count(DISTINCT d.source) AS n_publishers, count(DISTINCT d.text) AS n_contents, {STATUS} AS status
FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id"""


@query("claim_status", f"SELECT item_id, n_publishers, status FROM ({CORR})")
def claim_status(spark, d):
    return _corroboration(spark, d).select("item_id", "n_publishers", "status")


@query("claim_corroboration", f"SELECT item_id, n_publishers, n_contents, least(n_publishers, n_contents) >= 2 AS is_corroborated FROM ({CORR})")
def claim_corroboration(spark, d):
    return _corroboration(spark, d).select(
        "item_id", "n_publishers", "n_contents", (F.least("n_publishers", "n_contents") >= 2).alias("is_corroborated")
    )


# --- contradictions -----------------------------------------------------------------------------
NUMERIC = f"""WITH {NUM}, g AS (SELECT subject, attribute, min(CAST(value AS DOUBLE)) AS low, max(CAST(value AS DOUBLE)) AS high, count(*) AS n FROM nc GROUP BY 1, 2),
s AS (SELECT *, coalesce((high - low) / nullif(greatest(abs(low), abs(high)), 0), 0) AS spread FROM g),
x AS (SELECT *, CASE WHEN spread >= CAST(1.0 AS DOUBLE) THEN 'critical' WHEN spread >= CAST(0.5 AS DOUBLE) THEN 'high' WHEN spread >= CAST(0.2 AS DOUBLE) THEN 'medium' ELSE 'low' END AS severity
FROM s WHERE spread > CAST(0.05 AS DOUBLE))
"""


@query("contradiction_numeric", NUMERIC + "SELECT subject, n, round(low, 2) AS low, round(high, 2) AS high, round(spread, 6) AS spread, severity FROM x")
def contradiction_numeric(spark, d):
    return conflicts.numeric(_numeric(spark, d)).select(
        "subject", "n", F.round("low", 2).alias("low"), F.round("high", 2).alias("high"), F.round("spread", 6).alias("spread"), "severity"
    )


@query("contradiction_severity_hist", NUMERIC + "SELECT severity, count(*) AS n FROM x GROUP BY severity")
def contradiction_severity_hist(spark, d):
    return conflicts.numeric(_numeric(spark, d)).groupBy("severity").agg(F.count("*").alias("n"))


@query("contradiction_temporal", """SELECT CAST(o_orderkey AS VARCHAR) AS subject, CAST(o_orderdate AS DATE) AS starts, CAST(ends AS DATE) AS ends
FROM orders JOIN (SELECT l_orderkey, min(l_shipdate) AS ends FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderdate > ends""")
def contradiction_temporal(spark, d):
    ends = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("ends"))
    e = table(spark, d, "orders").join(ends, "o_orderkey").select(
        F.col("o_orderkey").cast("string").alias("subject"), F.col("o_orderdate").alias("starts"), "ends"
    )
    return conflicts.temporal(e).select("subject", F.col("starts").cast("date").alias("starts"), F.col("ends").cast("date").alias("ends"))


@query("contradiction_categorical", """SELECT CAST(l_orderkey AS VARCHAR) AS subject, CAST(l_linenumber AS VARCHAR) AS attribute, count(DISTINCT l_returnflag) AS n_values,
min(l_returnflag) AS first, max(l_returnflag) AS last FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(DISTINCT l_returnflag) > 1""")
def contradiction_categorical(spark, d):
    c = table(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("subject"), F.col("l_linenumber").cast("string").alias("attribute"), F.col("l_returnflag").alias("value")
    )
    return conflicts.categorical(c)


@query("contradiction_scope", """WITH p AS (SELECT l_orderkey, l_returnflag, min(l_linestatus) AS low, max(l_linestatus) AS high FROM lineitem GROUP BY 1, 2)
SELECT CAST(l_orderkey AS VARCHAR) AS subject, 'status' AS attribute, count(*) AS n_scopes, count(DISTINCT low) AS n_values FROM p WHERE low = high GROUP BY l_orderkey HAVING count(DISTINCT low) > 1""")
def contradiction_scope(spark, d):
    c = table(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("subject"), F.lit("status").alias("attribute"), F.col("l_returnflag").alias("scope"), F.col("l_linestatus").alias("value")
    )
    return conflicts.scoped(c)


# --- gaps -----------------------------------------------------------------------------------------
FACTS = """WITH facts AS (SELECT CAST(c_custkey AS VARCHAR) AS subject, count(DISTINCT o_orderkey) AS n_sources, count(l_orderkey) AS n_evidence,
  count(DISTINCT l_returnflag) AS n_dimensions, 3 AS n_expected, avg(CAST(l_discount * 10 AS DECIMAL(10, 4))) AS authority, max(l_tax) * 12 AS confidence,
  count(CASE WHEN l_shipdate < o_orderdate THEN 1 END) AS n_conflicts, date_diff('day', max(o_orderdate), DATE '1998-12-31') AS age_days
  FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 250000) ON o_custkey = c_custkey
  LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 30) ON l_orderkey = o_orderkey GROUP BY c_custkey)
"""


def _facts(spark: SparkSession, d: str, whole: bool = False) -> DataFrame:
    """Facts of customers, from large orders and lines or from all."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    if not whole:
        o, li = o.where("o_totalprice > 250000"), li.where("l_quantity > 30")
    joined = (
        table(spark, d, "customer").select("c_custkey").join(o, F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(li, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    )
    return joined.groupBy("c_custkey").agg(
        F.count_distinct("o_orderkey").alias("n_sources"), F.count("l_orderkey").alias("n_evidence"),
        F.count_distinct("l_returnflag").alias("n_dimensions"), F.lit(3).alias("n_expected"),
        F.avg((F.col("l_discount") * 10).cast("decimal(10,4)")).cast("double").alias("authority"),
        (F.max("l_tax") * 12).alias("confidence"), F.count_if(F.col("l_shipdate") < F.col("o_orderdate")).alias("n_conflicts"),
        F.datediff(F.lit("1998-12-31").cast("date"), F.max("o_orderdate").cast("date")).alias("age_days"),
    ).withColumn("subject", F.col("c_custkey").cast("string"))


GAP_SQL = {
    "no_sources": ("no_evidence", "high", "n_sources = 0"),
    "no_evidence": ("no_evidence", "critical", "n_sources > 0 AND n_evidence = 0"),
    "missing_dimension": ("missing_dimension", "medium", "n_dimensions < n_expected"),
    "coverage": ("insufficient_coverage", "medium", "n_evidence > 0 AND n_dimensions < 0.5 * n_expected"),
    "authority": ("weak_authority", "medium", "authority < CAST(0.4 AS DOUBLE)"),
    "uncorroborated": ("uncorroborated_claim", "medium", "n_evidence > 0 AND n_sources < 2"),
    "unresolved": ("unresolved_contradiction", "high", "n_conflicts > 0"),
    "stale": ("stale_evidence", "low", "age_days > 20"),
    "confidence": ("low_extraction_confidence", "low", "confidence < CAST(0.6 AS DOUBLE)"),
}


def _gap_rows(name: str) -> str:
    t, s, p = GAP_SQL[name]
    return f"SELECT subject, '{name}' AS condition, '{t}' AS gap_type, '{s}' AS severity FROM facts WHERE {p}"


def _gap(name: str) -> None:
    query(f"gaps_{name}", FACTS + _gap_rows(name))(lambda spark, d: gaps.gaps(_facts(spark, d), [name]))


for _name in GAP_SQL:
    _gap(_name)
ALL_GAPS = "\nUNION ALL\n".join(map(_gap_rows, GAP_SQL))


@query("gaps_all", FACTS + f"SELECT * FROM ({ALL_GAPS})")
def gaps_all(spark, d):
    return gaps.gaps(_facts(spark, d))


@query("open_questions", FACTS + f"""SELECT subject, gap_type, 'How can ' || replace(gap_type, '_', ' ') || ' of ' || subject || ' be resolved?' AS question,
CASE WHEN severity IN ('high', 'critical') THEN 'high' ELSE 'medium' END AS priority FROM ({ALL_GAPS}) WHERE severity <> 'low'""")
def open_questions(spark, d):
    return gaps.open_questions(gaps.gaps(_facts(spark, d)))


# --- diagnostics ---------------------------------------------------------------------------------
WIDE = """WITH w AS (SELECT CAST(l_orderkey AS VARCHAR) AS result_id, min(l_discount) * 10 AS relevance, max(l_tax) * 10 AS authority,
  CASE WHEN count(*) > 2 THEN 1.0 / count(*) END AS coverage, CAST(count(DISTINCT l_suppkey) AS DOUBLE) / count(*) AS independence,
  CAST(count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS DOUBLE) / count(*) AS contradiction_severity, CASE WHEN min(l_quantity) > 10 THEN 0.0 END AS uncertainty FROM lineitem GROUP BY 1)
"""


def _wide(spark: SparkSession, d: str) -> DataFrame:
    n = F.count("*")
    facts = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        (F.min("l_discount") * 10).alias("relevance"), (F.max("l_tax") * 10).alias("authority"), F.when(n > 2, 1.0 / n).alias("coverage"),
        (F.count_distinct("l_suppkey") / n).alias("independence"), (F.count_if(F.col("l_returnflag") == "R") / n).alias("contradiction_severity"),
        F.when(F.min("l_quantity") > 10, F.lit(0.0)).alias("uncertainty"),
    )
    return quality.wide(facts.withColumn("result_id", F.col("l_orderkey").cast("string")))


GIVEN = ("relevance", "authority", "coverage", "independence", "contradiction_severity", "uncertainty")
LONG = WIDE + ", l AS (" + " UNION ALL ".join(
    f"SELECT result_id, '{x}' AS dim, CAST({x if x in GIVEN else 'NULL'} AS DOUBLE) AS score FROM w" for x in DIMENSIONS
) + ")\n"


@query("quality_wide", WIDE + "SELECT result_id, " + ", ".join(f"round(CAST({x if x in GIVEN else 'NULL'} AS DOUBLE), 6) AS {x}" for x in DIMENSIONS) + " FROM w")
def quality_wide(spark, d):
    return _wide(spark, d).select("result_id", *(F.round(x, 6).alias(x) for x in DIMENSIONS))


@query("quality_long", LONG + "SELECT result_id, dim, round(score, 6) AS score FROM l")
def quality_long(spark, d):
    return accessors.dimensions(_wide(spark, d)).withColumn("score", F.round("score", 6))


@query("quality_available", LONG + "SELECT result_id, dim, round(score, 6) AS score FROM l WHERE score IS NOT NULL")
def quality_available(spark, d):
    return accessors.available_dimensions(_wide(spark, d)).withColumn("score", F.round("score", 6))


@query("quality_composite", LONG + f"""SELECT result_id, round(avg(CASE WHEN dim IN {LOWER_IS_BETTER} THEN 1 - score ELSE score END), 4) AS composite, count(*) AS n_available
FROM l WHERE score IS NOT NULL GROUP BY result_id""")
def quality_composite(spark, d):
    return quality.composite(_wide(spark, d)).withColumn("composite", F.round("composite", 4))


# --- synthesis, rendering, status --------------------------------------------------------------------
@query("synthesis_findings", f"""SELECT status, count(*) AS n, count(*) || ' claims are ' || replace(status, '_', ' ') || '.' AS finding,
md5(string_agg(lpad(CAST(item_id AS VARCHAR), 12, '0'), ',' ORDER BY lpad(CAST(item_id AS VARCHAR), 12, '0'))) AS ids_md5 FROM ({CORR}) GROUP BY status""")
def synthesis_findings(spark, d):
    return render.findings(_corroboration(spark, d).withColumnRenamed("item_id", "claim_id"))


@query("render_markdown", f"""SELECT '## ' || CASE status WHEN 'supported' THEN 'Supported' WHEN 'partially_supported' THEN 'Partially Supported' ELSE 'Unsupported' END AS section,
'- ' || item_id || ' (' || n_publishers || ' publishers)' AS line FROM ({CORR})""")
def render_markdown(spark, d):
    return render.markdown(_corroboration(spark, d).withColumnRenamed("item_id", "claim_id"))


@query("result_status", FACTS + f"""SELECT subject, CASE WHEN n_evidence = 0 THEN 'partial' ELSE 'complete' END AS status, CAST(coalesce(n_gaps, 0) AS BIGINT) AS n_gaps
FROM facts LEFT JOIN (SELECT subject, count(*) AS n_gaps FROM ({ALL_GAPS}) GROUP BY subject) USING (subject)""")
def result_status(spark, d):
    f = _facts(spark, d)
    n = F.size(F.array_compact(F.array(*(F.when(p, F.lit(1)) for _, _, p in gaps.conditions().values()))))
    return f.select("subject", F.when(F.col("n_evidence") == 0, "partial").otherwise("complete").alias("status"), n.cast("bigint").alias("n_gaps"))


# --- every row rule, defaults and time zones ----------------------------------------------------------
_BLANK = "trim({0}, " + WS + ") = ''"
_UNIT = "{0} IS NOT NULL AND NOT ({0} BETWEEN 0 AND 1)"
_SURE = "{0} IS NULL OR NOT ({0} BETWEEN 0 AND 1)"
_LEAST = "NOT {0} > 0"
RULE_SQL = {
    "requests": {"V01": _BLANK.format("question"), "V02": _BLANK.format("profile"), "V03": _LEAST.format("max_knowledge_results"),
                 "V04": _LEAST.format("max_web_results"), "V05": _LEAST.format("max_web_pages")},
    "sources": {"V06": _BLANK.format("source_id")},
    "evidence": {
        "V07": _BLANK.format("provenance_source_id"), "V09": "retrieval_rank < 0", "V10": _UNIT.format("retrieval_score"),
        "V11": _UNIT.format("provenance_confidence"), "V12": _UNIT.format("relevance"), "V13": _UNIT.format("authority"),
        "V14": _UNIT.format("recency"), "V15": _UNIT.format("quality_confidence"), "V16": _BLANK.format("link_claim_id"),
        "V17": _SURE.format("link_confidence"), "V18": _BLANK.format("evidence_id"), "V19": _BLANK.format("content"),
        "V20": _BLANK.format("source_id"),
    },
    "claims": {"V22": _BLANK.format("claim_id"), "V23": _BLANK.format("statement"), "V24": _SURE.format("confidence")},
    "contradictions": {"V25": _BLANK.format("contradiction_id"), "V26": _BLANK.format("description"), "V27": "n_claims + n_evidence < 2"},
    "gaps": {"V28": _BLANK.format("gap_id"), "V29": _BLANK.format("description")},
    "open_questions": {"V30": _BLANK.format("question")},
    "dimensions": {"V31": _UNIT.format("score")},
    "diagnostics": {"V32": _UNIT.format("composite")},
    "trace_events": {"V33": _BLANK.format("event_id"), "V34": _BLANK.format("message"), "V36": "duration_ms < 0"},
    "syntheses": {"V37": _BLANK.format("narrative"), "V39": _UNIT.format("confidence")},
}


def _broken(relation: str) -> None:
    """A query of all row rules of a relation, none of which holds everywhere."""
    columns = ", ".join(f"{sql} AS {k}" for k, sql in tables.BROKEN[relation].items()).replace("AS STRING", "AS VARCHAR")
    t = f"(SELECT CAST(l_orderkey AS VARCHAR) AS result_id, CAST(l_linenumber AS BIGINT) AS pos, {columns} FROM lineitem)"
    sql = "\nUNION ALL\n".join(
        f"SELECT result_id, pos, '{rule}' AS rule_id FROM {t} WHERE {broken}" for rule, broken in RULE_SQL[relation].items()
    )

    def run(spark: SparkSession, d: str) -> DataFrame:
        return row_violations(relation, tables.broken_graphs(spark, d)[relation]).select("result_id", "pos", "rule_id")

    query(f"rules_{relation}", sql)(run)


for _name in RULE_SQL:
    _broken(_name)


@query("rules_zones", "\nUNION ALL\n".join(
    f"SELECT {zone} AS has_zone, '{rule}' AS rule_id, '{relation}' AS relation FROM (SELECT any_value(typeof({cast})) AS t FROM orders) WHERE t = 'TIMESTAMP'"
    for zone, cast in (("true", "CAST(o_orderdate AS TIMESTAMPTZ)"), ("false", "o_orderdate"))
    for rule, relation in (("V08", "evidence"), ("V21", "evidence"), ("V35", "trace_events"), ("V38", "syntheses"), ("V40", "results"))))
def rules_zones(spark, d):
    rows = [(zone, rule, relation) for zone in (True, False)
            for rule, relation, _ in zone_violations(tables.timed_graphs(spark, d, zone))]
    return spark.createDataFrame(rows, "has_zone boolean, rule_id string, relation string")


DOMAIN_VALUES = {"severity": ("low", "huge"), "status": ("open", "closed"), "gap_type": ("no_evidence", "none")}


@query("rules_domains", "WITH g AS (SELECT CAST(l_orderkey AS VARCHAR) AS result_id, CAST(l_linenumber AS BIGINT) AS pos, l_partkey FROM lineitem)\n"
       + "\nUNION ALL\n".join(f"SELECT result_id, pos, '{f}' AS field FROM g WHERE l_partkey % {k + 2} = 0" for k, f in enumerate(DOMAIN_VALUES)))
def rules_domains(spark, d):
    li = table(spark, d, "lineitem")
    g = li.select(
        F.col("l_orderkey").cast("string").alias("result_id"), F.col("l_linenumber").cast("bigint").alias("pos"),
        *(F.when(F.col("l_partkey") % (k + 2) == 0, bad).otherwise(good).alias(f) for k, (f, (good, bad)) in enumerate(DOMAIN_VALUES.items())),
    )
    return domain_violations("gaps", g).select("result_id", "pos", "field")


@query("request_defaults", """SELECT CAST(o_orderkey AS VARCHAR) AS result_id, CAST(o_custkey AS BIGINT) AS pos, o_orderpriority AS question, CAST(0 AS INTEGER) AS n_profiles,
  true AS use_knowledge, o_orderstatus = 'F' AS use_web, CAST(10 AS BIGINT) AS max_knowledge_results,
  CAST(CASE WHEN o_custkey % 3 = 0 THEN 5 ELSE 7 END AS BIGINT) AS max_web_results, CAST(5 AS BIGINT) AS max_web_pages,
  CASE WHEN o_custkey % 2 = 0 THEN 'en' ELSE 'fr' END AS language, false AS strict, '{}' AS metadata FROM orders""")
def request_defaults(spark, d):
    given = table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("result_id"), F.col("o_custkey").cast("bigint").alias("pos"),
        F.col("o_orderpriority").alias("question"), F.when(F.col("o_orderstatus") == "F", F.lit(True)).alias("use_web"),
        F.when(F.col("o_custkey") % 3 != 0, F.lit(7)).cast("bigint").alias("max_web_results"),
        F.when(F.col("o_custkey") % 2 != 0, F.lit("fr")).alias("language"), F.lit("not a column").alias("stray"),
    )
    full = normalize.with_defaults("requests", given)
    return full.select(*(c for c in full.columns if c not in ("profiles", "as_of_date")), F.size("profiles").alias("n_profiles"))


@query("serialize_traces", """SELECT event_id AS pos, '{"event_id":"evt-' || event_id || '","stage":"' ||
  CASE event_type WHEN 'click' THEN 'retrieval' WHEN 'view' THEN 'extraction' WHEN 'purchase' THEN 'synthesis' WHEN 'signup' THEN 'init' WHEN 'error' THEN 'other' END ||
  '","seen":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE '.' || strftime(ts, '%f') END ||
  '","occurred_at":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE '.' || strftime(ts, '%f') END ||
  '+00:00","day":"' || strftime(ts, '%Y-%m-%d') || '","flags":[' || (user_id % 2 = 0) || ',null],"payload":' || props || ',"notes":{"stage":null,"metadata":' ||
  CASE WHEN user_id % 3 = 0 THEN 'null' ELSE '{"user":' || user_id || '}' END || '}}' AS json FROM events""")
def serialize_traces(spark, d):
    e = tables.trace_of_events(table(spark, d, "events"))
    user = F.col("result_id").cast("bigint")
    utc = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("occurred_at"))  # the column holds UTC
    e = e.select(
        "result_id", "pos", "event_id", "stage", F.col("occurred_at").alias("seen"), utc.cast("timestamp").alias("occurred_at"),
        F.col("seen").cast("date").alias("day"), F.array(user % 2 == 0, F.lit(None).cast("boolean")).alias("flags"), "payload",
        F.struct(F.lit(None).cast("string").alias("stage"),
                 F.when(user % 3 != 0, F.concat(F.lit('{"user":'), user.cast("string"), F.lit("}"))).alias("metadata")).alias("notes"),
    )
    return e.select("pos", to_json(e, "result_id", "pos").alias("json"))


@query("serialize_dates", """SELECT o_orderkey AS pos, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(o_orderdate) % 1000000 = 0 THEN '' ELSE '.' || strftime(o_orderdate, '%f') END AS local,
  strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""")
def serialize_dates(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("pos"), iso_local("o_orderdate").alias("local"), iso_date(F.col("o_orderdate").cast("date")).alias("day")
    )


# --- whole tables ----------------------------------------------------------------------------------------
@query("retrieve_ranked", """WITH t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}'))) AS term FROM documents),
q AS (SELECT conv_id || '-' || turn AS request_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}'))) AS term FROM conversations WHERE role = 'user'),
h AS (SELECT request_id, doc_id, count(*) AS n_shared FROM q JOIN t USING (term) GROUP BY 1, 2)
SELECT request_id, CAST(rank AS INTEGER) AS rank, doc_id, n_shared FROM (
SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY n_shared DESC, doc_id) AS rank FROM h) WHERE rank <= 10""")
def retrieve_ranked(spark, d):
    """The ten best documents by all shared terms, however common."""
    asked = _requests(spark, d).select(F.col("result_id").alias("request_id"), "question")
    return retrieve.retrieve(asked, table(spark, d, "documents"), 10)


ALL_FACTS = FACTS.replace(" WHERE o_totalprice > 250000", "").replace(" WHERE l_quantity > 30", "")


@query("gaps_every", ALL_FACTS + f"SELECT * FROM ({ALL_GAPS})")
def gaps_every(spark, d):
    """Gaps of all customers from all orders and lines."""
    return gaps.gaps(_facts(spark, d, whole=True))


@query("open_questions_every", ALL_FACTS + f"""SELECT subject, gap_type, 'How can ' || replace(gap_type, '_', ' ') || ' of ' || subject || ' be resolved?' AS question,
CASE WHEN severity IN ('high', 'critical') THEN 'high' ELSE 'medium' END AS priority FROM ({ALL_GAPS}) WHERE severity <> 'low'""")
def open_questions_every(spark, d):
    """Open questions from all orders and lines."""
    return gaps.open_questions(gaps.gaps(_facts(spark, d, whole=True)))


# --- contested claims, contradictions as records -------------------------------------------------------------
@query("claim_statuses", """WITH c AS (SELECT CAST(l_orderkey AS VARCHAR) AS claim_id, count(DISTINCT CASE WHEN l_returnflag = 'A' THEN l_suppkey END) AS pro,
  count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_suppkey END) AS contra, bool_and(l_linestatus = 'O') AS only_web FROM lineitem GROUP BY 1)
SELECT claim_id, CASE WHEN pro > 0 AND contra > 0 THEN 'contested' WHEN pro >= 2 THEN 'supported' WHEN pro = 1 AND only_web THEN 'unresolved'
  WHEN pro = 1 THEN 'partially_supported' ELSE 'unsupported' END AS status FROM c""")
def claim_statuses(spark, d):
    """Status of an order's claim: suppliers of accepted lines for, of
    returned ones against; open lines stand for the web."""
    c = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("claim_id")).agg(
        F.count_distinct(F.when(F.col("l_returnflag") == "A", F.col("l_suppkey"))).alias("pro"),
        F.count_distinct(F.when(F.col("l_returnflag") == "R", F.col("l_suppkey"))).alias("contra"),
        F.bool_and(F.col("l_linestatus") == "O").alias("only_web"),
    )
    return c.select("claim_id", claims.status(F.col("pro"), F.col("contra"), F.col("only_web")).alias("status"))


@query("contradiction_pairs", NUMERIC + """SELECT subject, subject || '/' || hi.scope AS claim_id, x.subject || '/' || lo.scope AS other_id FROM (SELECT * FROM x) x
JOIN (SELECT subject, attribute, min(scope) AS scope FROM nc JOIN (SELECT subject, attribute, low FROM x) USING (subject, attribute) WHERE CAST(value AS DOUBLE) = low GROUP BY 1, 2) lo USING (subject, attribute)
JOIN nc hi USING (subject, attribute) WHERE (CAST(hi.value AS DOUBLE) - x.low) / nullif(greatest(abs(CAST(hi.value AS DOUBLE)), abs(x.low)), 0) > CAST(0.05 AS DOUBLE)""")
def contradiction_pairs(spark, d):
    """Claims that contradict the lowest one of their group, by id."""
    return conflicts.numeric_pairs(_numeric(spark, d)).select("subject", "claim_id", "other_id")


#: What may go wrong in a run (by an order's number), the run's status and
#: whether a strict request fails.
DEGRADATION = (
    ("nothing", "complete", False), ("no evidence", "partial", True), ("one provider failed", "partial", True),
    ("all providers failed", "raised", True), ("extraction failed", "partial", True),
    ("contradiction detection failed", "partial", True), ("gap analysis failed", "partial", True),
    ("synthesis failed", "partial", True), ("rendering failed", "complete", False), ("unknown profile", "raised", True),
    ("invalid request", "raised", True), ("broken graph", "raised", True),
)


@query("degradation", "SELECT CAST(o_orderkey AS VARCHAR) AS result_id, CASE o_orderkey % 12 " + " ".join(
    f"WHEN {k} THEN '{s}'" for k, (_, s, _) in enumerate(DEGRADATION)) + " END AS status, CASE o_orderkey % 12 " + " ".join(
    f"WHEN {k} THEN {str(f).lower()}" for k, (_, _, f) in enumerate(DEGRADATION)) + " END AS fails_strict FROM orders")
def degradation(spark, d):
    """Status of runs from the events of their traces."""
    o = table(spark, d, "orders")
    names = F.array(*(F.lit(n) for n, _, _ in DEGRADATION))
    seen = o.select(F.col("o_orderkey").cast("string").alias("result_id"), F.element_at(names, (F.col("o_orderkey") % 12 + 1).cast("int")).alias("condition"))
    return engine.outcome(seen).select("result_id", "status", "fails_strict")
