"""Queries with SQL against it, and the pipeline against its parts."""

from __future__ import annotations

import pytest

from claimloom.llm.queries import QUERIES, SQL
from tests.oracle import connect, rows

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    mine, theirs = QUERIES[name](spark, FOLDER).toPandas(), connect(FOLDER).sql(SQL[name]).df()
    assert rows(mine) == rows(theirs)


def test_names():
    assert [sum(n.startswith(f"op{k}_") for n in QUERIES) for k in range(1, 11)] == [1] * 10


def test_pipeline(spark):
    import corpus_pipeline
    from claimloom.llm import decontaminate, simhash, toxicity

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    out = corpus_pipeline.run(spark, FOLDER).toPandas()
    assert list(out.columns[:5]) == docs.columns and out.round_trip.all()
    # by brute force from the operators' own per-document results
    calm = {r.doc_id for r in toxicity.toxicity(docs, labels).where("predicted = 0").collect()}
    rest = docs.where(docs.doc_id.isin(*calm))
    unique = {r.component_id for r in simhash.near_duplicates(rest).collect()}
    clean = {r.doc_id for r in decontaminate.decontaminate(rest.where(rest.doc_id.isin(*unique)), bench).where("not contaminated").collect()}
    assert set(out.doc_id) == clean and len(out) == len(clean)


def test_stages_on_nothing(spark):
    import corpus_pipeline

    d = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, FOLDER)
        assert d.isEmpty()
