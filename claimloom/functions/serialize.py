"""Relations as JSON text, nulls kept, fields in the order of the schema.

Times and dates are ISO 8601 text; columns that hold JSON text (metadata,
payloads) leave as the objects they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DateType, StringType, StructType, TimestampNTZType, TimestampType

from claimloom.functions.columns import iso_date, iso_local, iso_timestamp

#: Fields of JSON text.
JSON_TEXT = ("metadata", "payload")
#: Relations of one row a result, and their names in a whole result.
SINGLE = {"requests": "request", "diagnostics": "diagnostics", "syntheses": "synthesis"}
MANY = ("sources", "evidence", "claims", "contradictions", "gaps", "open_questions", "dimensions", "trace_events")


def _value(c: Column) -> Column:
    """A scalar as JSON; null stays null."""
    boxed = F.to_json(F.array(c), {"ignoreNullFields": "false"})
    return F.when(c.isNotNull(), F.regexp_replace(boxed, r"^\[|\]$", ""))


def _json(c: Column, kind: DataType, name: str = "") -> Column:
    """A value as JSON text, all the way down; ``null`` for null."""
    if isinstance(kind, TimestampType):
        text = F.concat(F.lit('"'), iso_timestamp(c), F.lit('"'))
    elif isinstance(kind, TimestampNTZType):
        text = F.concat(F.lit('"'), iso_local(c), F.lit('"'))
    elif isinstance(kind, DateType):
        text = F.concat(F.lit('"'), iso_date(c), F.lit('"'))
    elif isinstance(kind, StructType):
        text = F.when(c.isNotNull(), _object([(f.name, _json(c[f.name], f.dataType, f.name)) for f in kind]))
    elif isinstance(kind, ArrayType):
        inner = F.array_join(F.transform(c, lambda x: _json(x, kind.elementType)), ",")
        text = F.concat(F.lit("["), inner, F.lit("]"))
    elif isinstance(kind, StringType) and name in JSON_TEXT:
        text = F.coalesce(F.when(F.get_json_object(c, "$").isNotNull(), c), _value(c))
    else:
        text = _value(c)
    return F.coalesce(text, F.lit("null"))


def _object(fields: list[tuple[str, Column]]) -> Column:
    parts = [x for k, (name, text) in enumerate(fields) for x in (F.lit(f'{"," if k else ""}"{name}":'), text)]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def to_json(df: DataFrame, *but: str) -> Column:
    """JSON object of a row without some columns."""
    return _object([(f.name, _json(F.col(f.name), f.dataType, f.name)) for f in df.schema if f.name not in but])


def serialize_relation(df: DataFrame) -> DataFrame:
    """``result_id, pos, json`` of each row."""
    return df.select("result_id", "pos", to_json(df, "result_id", "pos").alias("json"))


def serialize_results(relations: dict[str, DataFrame]) -> DataFrame:
    """``result_id, json`` of whole results, members in order.

    The result's own fields come first, then its request, members, trace,
    diagnostics and synthesis; absent relations are left out, a result
    without a synthesis has null there.  One result is one row by nature;
    results are meant to be of a size that a reader can hold.  Relations
    stay the form for anything larger.
    """
    results = relations["results"]
    out = results.select("result_id", *(_json(F.col(f.name), f.dataType, f.name).alias(f"_{f.name}")
                                        for f in results.schema if f.name not in ("result_id", "pos")))
    fields = [(c[1:], F.col(c)) for c in out.columns[1:]]
    for name in [*SINGLE, *MANY]:
        if name not in relations:
            continue
        df = relations[name]
        rows = serialize_relation(df if "pos" in df.columns else df.withColumn("pos", F.lit(0))).groupBy("result_id")
        if name in SINGLE:
            out = out.join(rows.agg(F.min_by("json", "pos").alias(name)), "result_id", "left")
            fields.append((SINGLE[name], F.coalesce(name, F.lit("null"))))
        else:
            members = F.transform(F.array_sort(F.collect_list(F.struct("pos", "json"))), lambda x: x["json"])
            out = out.join(rows.agg(F.array_join(members, ",").alias(name)), "result_id", "left")
            fields.append((name, F.concat(F.lit("["), F.coalesce(name, F.lit("")), F.lit("]"))))
    return out.select("result_id", _object(fields).alias("json"))
