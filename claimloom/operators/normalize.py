"""Normalisation of requests and evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions import digest, strip
from claimloom.schema import DEFAULTS, schema_of


def with_defaults(relation: str, df: DataFrame) -> DataFrame:
    """All columns of a relation: absent ones null, null ones that have a
    default filled with it; further columns stay behind."""
    kinds = {f.name: f.dataType for f in schema_of(relation)}
    cols = []
    for name, kind in kinds.items():
        c = F.col(name) if name in df.columns else F.lit(None).cast(kind)
        default = DEFAULTS[relation].get(name)
        if default is not None:
            value = F.array().cast(kind) if default == [] else F.lit(default).cast(kind)
            c = F.coalesce(c, value)
        cols.append(c.alias(name))
    return df.select(*cols)


def normalise_requests(df: DataFrame) -> DataFrame:
    """Trim the question; trim profiles and keep the first of equal ones."""
    return df.withColumn("question", strip("question")).withColumn(
        "profiles", F.array_distinct(F.transform("profiles", strip))
    )


def unify(*evidence: DataFrame) -> DataFrame:
    """Evidence of several providers as one relation, nothing altered."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), evidence)


def deduplicate(df: DataFrame, content_col: str = "content", id_col: str = "evidence_id") -> DataFrame:
    """Per content hash: the first id, how often, by how many publishers.

    One aggregation over hashes; the content itself is not shuffled.
    """
    return (
        df.select(digest(content_col).alias("content_hash"), id_col, "publisher")
        .groupBy("content_hash")
        .agg(F.min(id_col).alias(id_col), F.count("*").alias("n"), F.count_distinct("publisher").alias("n_publishers"))
    )
