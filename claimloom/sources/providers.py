"""Providers: the extension surface, as structural protocols on frames.

Any object with the methods qualifies.  Stages are independent of each
other; the engine wires them.
"""

from __future__ import annotations

from typing import Any, Protocol, TypeVar, runtime_checkable

from pyspark.sql import DataFrame, SparkSession

Out_co = TypeVar("Out_co", covariant=True)


@runtime_checkable
class KnowledgeProvider(Protocol):
    """Evidence (never None, maybe empty) for retrieval requests."""

    def retrieve(self, requests: DataFrame) -> DataFrame: ...


@runtime_checkable
class WebSearchProvider(Protocol):
    """Sources and evidence of pages; a page may yield many pieces."""

    def search(self, requests: DataFrame) -> tuple[DataFrame, DataFrame]: ...


@runtime_checkable
class ProfileProvider(Protocol):
    """All profiles that can be resolved: ``profile_id, config, ...``."""

    def profiles(self) -> DataFrame: ...


@runtime_checkable
class ClaimExtractor(Protocol):
    """Claims with unique ids from evidence."""

    def extract(self, evidence: DataFrame, requests: DataFrame) -> DataFrame: ...


@runtime_checkable
class ContradictionDetector(Protocol):
    """Contradictions between claims; inputs stay as they are."""

    def detect(self, claims: DataFrame, evidence: DataFrame, requests: DataFrame) -> DataFrame: ...


@runtime_checkable
class GapAnalyzer(Protocol):
    """Gaps and open questions."""

    def analyze(
        self, claims: DataFrame, evidence: DataFrame, contradictions: DataFrame, requests: DataFrame
    ) -> tuple[DataFrame, DataFrame]: ...


@runtime_checkable
class Synthesizer(Protocol):
    """Syntheses of results, from what is there only."""

    def synthesize(self, relations: dict[str, DataFrame]) -> DataFrame: ...


@runtime_checkable
class Renderer(Protocol[Out_co]):
    """Any output from a result, which it does not change."""

    def render(self, relations: dict[str, DataFrame]) -> Out_co: ...


class ParquetKnowledge:
    """Knowledge from a folder's documents by shared search terms."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def retrieve(self, requests: DataFrame) -> DataFrame:
        """Evidence of the best documents, up to each request's limit."""
        from pyspark.sql import functions as F

        from claimloom.operators.retrieve import retrieve
        from claimloom.sources.tables import table

        docs = table(self.spark, self.folder, "documents")
        asked = requests.select(F.col("result_id").alias("request_id"), "question")
        most = requests.agg(F.max("max_knowledge_results")).first()[0] or 0
        found = retrieve(asked, docs, int(most)).join(
            requests.select(F.col("result_id").alias("request_id"), "max_knowledge_results"), "request_id"
        ).where(F.col("rank") <= F.col("max_knowledge_results"))
        key = F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))
        return found.join(docs, "doc_id").select(
            F.col("request_id").alias("result_id"), F.col("rank").cast("bigint").alias("pos"),
            key.alias("evidence_id"), F.col("text").alias("content"), key.alias("source_id"),
            F.col("source").alias("publisher"), F.lit("knowledge").alias("source_type"),
            F.col("n_shared").alias("n_shared"),
        )


class ParquetWeb:
    """Pages of a folder in the place of a search engine."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def search(self, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Sources and excerpts of the best pages by shared terms, up to
        each request's number of pages."""
        from pyspark.sql import functions as F

        from claimloom.operators.retrieve import page_text, retrieve, web_excerpts, web_sources
        from claimloom.sources.tables import table

        pages = table(self.spark, self.folder, "pages")
        asked = requests.select(F.col("result_id").alias("request_id"), "question")
        most = requests.agg(F.max("max_web_pages")).first()[0] or 0
        texts = pages.select("page_id", page_text("html").alias("text"))
        found = retrieve(asked, texts, int(most), "page_id").join(
            requests.select(F.col("result_id").alias("request_id"), "max_web_pages"), "request_id"
        ).where(F.col("rank") <= F.col("max_web_pages")).select(
            F.col("request_id").alias("result_id"), (F.col("rank") - 1).cast("bigint").alias("pos"),
            F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("source_id"),
        )
        sources = found.join(web_sources(pages), "source_id")
        evidence = found.join(web_excerpts(pages).join(web_sources(pages).select("source_id", "publisher"), "source_id"), "source_id")
        return sources, evidence.select(
            "result_id", "pos", F.concat("source_id", F.lit("#0")).alias("evidence_id"), "content", "source_id", "publisher",
            F.lit("web").alias("source_type"),
        )


class StaticProfiles:
    """Profiles from a mapping of id to configuration (JSON text)."""

    def __init__(self, spark: SparkSession, known: dict[str, str]):
        self.spark, self.known = spark, known

    def profiles(self) -> DataFrame:
        """``profile_id, config``."""
        rows: list[tuple[Any, ...]] = sorted(self.known.items())
        return self.spark.createDataFrame(rows, "profile_id string, config string")
