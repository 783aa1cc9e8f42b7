"""Runs of the engine, streams and files."""

from __future__ import annotations

import pytest

from claimloom import errors
from claimloom.plans.engine import Engine
from claimloom.sources import providers, tables
from claimloom.streaming.trace_stream import read_events, windowed

FOLDER = "/root/testdata/sf0.001"


class Broken:
    def retrieve(self, requests):
        raise RuntimeError("no")


class Web:
    def __init__(self, spark):
        self.spark = spark

    def search(self, requests):
        return (self.spark.createDataFrame([("r", "page:1")], "result_id string, source_id string"),
                self.spark.createDataFrame([("r", "page:1", "text")], "result_id string, source_id string, content string"))


class Claims:
    def extract(self, evidence, requests):
        return evidence.selectExpr("result_id", "evidence_id AS claim_id")


def requests(spark, question="with the that", profiles=None):
    return spark.createDataFrame([("r", question, profiles or [])], "result_id string, question string, profiles array<string>")


def test_run(spark):
    text = tables.table(spark, FOLDER, "documents").where("lang = 'en'").first().text
    e = Engine(spark, knowledge=providers.ParquetKnowledge(spark, FOLDER), extractor=Claims(),
               profiles=providers.StaticProfiles(spark, {"p": "{}"}))
    out = e.run(requests(spark, text, ["p"]))
    assert out.status == "complete"
    n = out.relations["evidence"].count()
    assert 0 < n <= 10 and out.relations["claims"].count() == n


def test_failures(spark):
    k = providers.ParquetKnowledge(spark, FOLDER)
    with pytest.raises(errors.UnsupportedConfiguration):
        Engine(spark)
    with pytest.raises(errors.UnsupportedConfiguration):
        Engine(spark, knowledge=object())
    with pytest.raises(errors.InvalidRequest):
        Engine(spark, knowledge=k).run(requests(spark, "  "))
    with pytest.raises(errors.UnknownProfile) as x:
        Engine(spark, knowledge=k, profiles=providers.StaticProfiles(spark, {"p": "{}"})).run(requests(spark, profiles=["p", "q"]))
    assert x.value.profile_id == "q"
    with pytest.raises(errors.ProviderFailed):
        Engine(spark, knowledge=Broken()).run(requests(spark))
    out = Engine(spark, knowledge=Broken(), web=Web(spark)).run(requests(spark))
    assert out.status == "partial" and out.relations["evidence"].count() == 1
    with pytest.raises(errors.IncompleteResult):
        Engine(spark, knowledge=Broken(), web=Web(spark)).run(requests(spark), strict=True)


def test_no_evidence_is_partial(spark):
    out = Engine(spark, knowledge=providers.ParquetKnowledge(spark, FOLDER)).run(requests(spark, "zzzzqqq"))
    assert out.status == "partial"


def test_relations_on_disk(spark, tmp_path):
    g = {"gaps": tables.order_graphs(spark, FOLDER)["gaps"]}
    for fmt in ("parquet", "orc"):
        tables.write_relations(g, f"{tmp_path}/{fmt}", fmt)
        back = tables.read_relations(spark, f"{tmp_path}/{fmt}", ["gaps"], fmt)["gaps"]
        assert back.count() == g["gaps"].count()


def test_trace_stream(spark, tmp_path):
    t = tables.trace_of_events(tables.table(spark, FOLDER, "events")).selectExpr("* EXCEPT (occurred_at)", "CAST(occurred_at AS timestamp) AS occurred_at")
    t.write.parquet(f"{tmp_path}/in")
    q = windowed(read_events(spark, f"{tmp_path}/in", t), "1 day").writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM w").first()[0] == t.count()


def test_cli(spark, capsys):
    from claimloom.cli import main

    assert main([FOLDER, "--query", "trace_durations", "--format", "json"]) == 0
    assert main([FOLDER, "--question", "x", "--profile", "nobody"]) == 1
    assert "nobody" in capsys.readouterr().err
