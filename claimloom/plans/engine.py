"""One run: validate, dispatch, analyse, collect, with partial results.

The orchestrator holds no analysis of its own.  A provider's output is
materialised inside the ``try``, since a lazy frame would fail later.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.errors import (
    IncompleteResult, InvalidRequest, ProviderFailed, ProviderUnavailable, UnsupportedConfiguration,
)
from claimloom.operators.accessors import require_profiles
from claimloom.operators.normalize import normalise_requests, with_defaults
from claimloom.operators.rules import row_violations
from claimloom.operators.validate import check
from claimloom.plans import stages
from claimloom.schema import schema_of
from claimloom.sources.providers import (
    ClaimExtractor, ContradictionDetector, GapAnalyzer, KnowledgeProvider, ParquetKnowledge, ParquetWeb, ProfileProvider,
    Renderer, Synthesizer, WebSearchProvider,
)


@dataclass
class Run:
    """Outcome of a run: status, relations, trace, rendered output."""

    status: str
    relations: dict[str, DataFrame]
    trace: list[tuple[str, str, str]] = field(default_factory=list)
    rendered: object = None

    def events(self) -> DataFrame:
        """The trace as a relation of every result of the run."""
        results = self.relations["results"].select("result_id")
        rows = [(k, f"evt-{k}", *event) for k, event in enumerate(self.trace)]
        trace = results.sparkSession.createDataFrame(rows, "pos bigint, event_id string, stage string, status string, message string")
        return results.crossJoin(F.broadcast(trace))  # a dozen events


def outcome(conditions: DataFrame) -> DataFrame:
    """``result_id, condition, status, fails_strict``: what a run ends
    with under a condition, as ``run`` has it.

    Errors before retrieval, no provider at all and a broken graph raise;
    a renderer can't spoil a result; anything else that fails or finds
    nothing leaves a partial result, which a strict request refuses.
    """
    raises = F.col("condition").isin("all providers failed", "unknown profile", "invalid request", "broken graph")
    whole = F.col("condition").isin("nothing", "rendering failed")
    return conditions.select(
        "result_id", "condition", F.when(raises, "raised").when(whole, "complete").otherwise("partial").alias("status"),
        (~whole).alias("fails_strict"),
    )


@dataclass
class Engine:
    """Providers of every stage; all but knowledge or web are optional."""

    spark: SparkSession
    knowledge: KnowledgeProvider | None = None
    web: WebSearchProvider | None = None
    profiles: ProfileProvider | None = None
    extractor: ClaimExtractor | None = None
    detector: ContradictionDetector | None = None
    gaps: GapAnalyzer | None = None
    synthesizer: Synthesizer | None = None
    renderer: Renderer | None = None
    _kept: list[DataFrame] = field(default_factory=list, repr=False)

    def __post_init__(self) -> None:
        kinds = (
            ("knowledge", KnowledgeProvider), ("web", WebSearchProvider), ("profiles", ProfileProvider),
            ("extractor", ClaimExtractor), ("detector", ContradictionDetector), ("gaps", GapAnalyzer),
            ("synthesizer", Synthesizer), ("renderer", Renderer),
        )
        for name, kind in kinds:
            value = getattr(self, name)
            if value is not None and not isinstance(value, kind):
                raise UnsupportedConfiguration(f"{name} is no {kind.__name__}")
        if self.knowledge is None and self.web is None:
            raise UnsupportedConfiguration("neither a knowledge nor a web provider")

    @classmethod
    def standard(cls, spark: SparkSession, folder: str, web: bool = False) -> Engine:
        """An engine over a folder's tables with the built-in stages."""
        return cls(
            spark, knowledge=ParquetKnowledge(spark, folder), web=ParquetWeb(spark, folder) if web else None,
            extractor=stages.SentenceClaims(), detector=stages.NumberConflicts(), gaps=stages.FactGaps(),
            synthesizer=stages.CountSynthesis(), renderer=stages.Markdown(),
        )

    def run(self, requests: DataFrame, strict: bool = False) -> Run:
        """Run all stages over the requests.

        Raises on invalid requests, unknown profiles, providers that all
        fail, a graph that breaks rules, and - where strict, here or in a
        request - instead of a partial result.  ``results`` has a status
        for each request: one without evidence is partial, whatever the
        others have.
        """
        out = Run("complete", {})
        requests = with_defaults("requests", requests)
        bad = row_violations("requests", requests).limit(5).collect()
        if bad:
            raise InvalidRequest("requests break rules", rows=bad)
        requests = normalise_requests(requests)
        out.relations["requests"] = requests
        if requests.where(F.size("profiles") > 0).limit(1).count():
            if self.profiles is None:
                raise UnsupportedConfiguration("requests ask for profiles and there is no provider")
            out.relations["profiles"] = require_profiles(requests, self.profiles.profiles())
        self._retrieve(out, requests)
        ev = out.relations.get("evidence")
        found = ev is not None and not ev.isEmpty()
        if not found:
            out.status = "partial"
            out.trace.append(("retrieval", "partial", "no evidence"))
        else:
            self._stage(out, "extraction", self.extractor, lambda p: {"claims": p.extract(ev, requests)})
            cl = out.relations.get("claims")
            if cl is not None:
                self._stage(
                    out, "contradiction_detection", self.detector, lambda p: {"contradictions": p.detect(cl, ev, requests)}
                )
        # gaps are looked for without claims, too: nothing found is the first of them
        given = lambda name: out.relations.get(name, self.spark.createDataFrame([], schema_of(name)))
        self._stage(
            out, "gap_analysis", self.gaps,
            lambda p: dict(zip(("gaps", "open_questions"),
                               p.analyze(given("claims"), given("evidence"), given("contradictions"), requests))),
        )
        if out.status == "complete" and "claims" in out.relations:
            self._stage(out, "synthesis", self.synthesizer, lambda p: {"syntheses": p.synthesize(out.relations)})
        has = ev.select("result_id").distinct() if found else self.spark.createDataFrame([], "result_id string")
        broken = F.lit(any(s == "failed" for _, s, _ in out.trace))
        results = requests.select("result_id", "strict").join(has.withColumn("has", F.lit(True)), "result_id", "left").select(
            "result_id", F.lit(0).cast("bigint").alias("pos"),
            F.when(F.col("has") & ~broken, "complete").otherwise("partial").alias("status"), "strict",
        )
        out.relations["results"] = self._keep(results.drop("strict"))
        refused = results.where("status = 'partial'").where(F.lit(strict) | F.col("strict")).limit(5).collect()
        if refused:
            raise IncompleteResult("strict results would be partial", results=[r.result_id for r in refused], trace=out.trace)
        if out.status == "complete" and not out.relations["results"].where("status = 'partial'").isEmpty():
            out.status = "partial"
        # a complete result needs sources only where sources are a relation of the run
        graph = {
            k: df if "pos" in df.columns else df.withColumn("pos", F.lit(0).cast("bigint"))
            for k, df in out.relations.items() if k not in ("requests", "profiles") and "result_id" in df.columns
        }
        check(graph if "sources" in graph and self.knowledge is None else {k: v for k, v in graph.items() if k != "sources"})
        out.trace.append(("finalization", "completed", out.status))
        if self.renderer is not None:
            try:
                out.rendered = self.renderer.render(dict(out.relations))
            except Exception as e:  # a renderer can't spoil the result
                out.trace.append(("rendering", "failed", str(e)))
        return out

    def release(self) -> None:
        """Let go of what runs have kept in memory."""
        for df in self._kept:
            df.unpersist()
        self._kept.clear()

    def _keep(self, df: DataFrame) -> DataFrame:
        self._kept.append(df := df.persist())
        return df

    def _retrieve(self, out: Run, requests: DataFrame) -> None:
        failures = []
        calls = []
        if self.knowledge is not None:
            calls.append(("knowledge", lambda: {"evidence": self.knowledge.retrieve(requests.where("use_knowledge"))}))
        if self.web is not None:
            calls.append(("web", lambda: dict(zip(("sources", "evidence"), self.web.search(requests.where("use_web"))))))
        for name, call in calls:
            try:
                for relation, df in call().items():
                    df = self._keep(df)
                    n = df.count()
                    had = out.relations.get(relation)
                    out.relations[relation] = df if had is None else had.unionByName(df, allowMissingColumns=True)
                    out.trace.append(("retrieval", "completed", f"{name}: {n} {relation}"))
            except Exception as e:
                failures.append((name, e))
                out.trace.append(("retrieval", "failed", f"{name}: {e}"))
        if len(failures) == len(calls):
            name, e = failures[0]
            kind = ProviderUnavailable if isinstance(e, (ConnectionError, ProviderUnavailable)) else ProviderFailed
            raise kind("no provider answered", provider=name, cause=str(e)) from e
        if failures:
            out.status = "partial"

    def _stage(self, out: Run, stage: str, provider, call) -> None:
        if provider is None:
            out.trace.append((stage, "skipped", "no provider"))
            return
        try:
            for relation, df in call(provider).items():
                df = self._keep(df)
                out.trace.append((stage, "completed", f"{df.count()} {relation}"))
                out.relations[relation] = df
        except Exception as e:
            out.status = "partial"
            out.trace.append((stage, "failed", str(e)))
