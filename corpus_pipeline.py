"""A training-corpus pipeline over ``documents``, stage by stage.

Every stage takes ``(spark, docs, sf_dir)`` and returns what it keeps
with the columns of ``docs``; the last one adds token columns.  The
driver writes each result and reads it again as the next stage's input.

Null texts count as empty everywhere and stay unless a stage says
otherwise; repeated rows are one near-duplicate group, of which one row
stays; an empty table passes through; extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import decontaminate, near_copies, secrets, sentencepiece_codec, toxicity
from claimloom.llm.common import Scratch, bounded_batches
from claimloom.llm.queries import piece_model

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (score below 0.5)."""
    bounded_batches(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.score_column("text", model, spark) < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id:
    SimHash of five-word shingles, Golay keys, verified at a Jaccard
    similarity of 0.8."""
    bounded_batches(spark)
    return near_copies.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    bounded_batches(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return docs.where(~decontaminate.contaminated_column("text", benchmark))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; ``n_chars`` follows."""
    bounded_batches(spark)
    masked = docs.withColumn("text", secrets.masked_column("text", secrets.fit(docs)))
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with ``token_ids``, ``n_tokens`` and ``round_trip``
    (the ids decode to the text; a null text encodes as the empty one).
    Columns of ``docs`` under these names give way to them."""
    bounded_batches(spark)
    docs = docs.drop("token_ids", "n_tokens", "round_trip")
    return docs.select("*", sentencepiece_codec.coded_column("text", piece_model()).alias("_coded")).select(
        *docs.columns, F.col("_coded.ids").alias("token_ids"), F.size("_coded.ids").cast("bigint").alias("n_tokens"),
        F.col("_coded.round_trip").alias("round_trip"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("sentencepiece", encode),
]

#: SQL can express neither the trained classifier nor the fingerprints.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between two of them the lineage is
    cut by a table in the shared checkpoint folder, dropped once the next
    one is written."""
    scratch, last = Scratch(spark), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = scratch.table(docs)
            if last is not None:
                scratch.drop(last)
            last = docs
    return docs
