"""Claims, what supports them, and their status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Independent publishers that make a claim supported.
INDEPENDENT = 2
#: First signs of a passage under three words that it is joined on.
SIGNS = 8


def passages_in(docs: DataFrame, passages: DataFrame, doc_id: str = "doc_id", text: str = "text",
                item_id: str = "item_id", passage: str = "text") -> DataFrame:
    """``item_id, doc_id`` where a passage occurs in a document.

    Not a nested loop: an occurrence contains the passage's longest
    interior word (the first and last may be cut), so the two sides are
    joined on it and then verified.  Passages of fewer than three words
    have none: these are joined on their first ``SIGNS`` signs (all, if
    shorter) with the runs of so many signs of the documents.
    """
    p = passages.select(F.col(item_id).alias("item_id"), F.col(passage).alias("passage"))
    inner = F.slice(F.split("passage", " "), 2, F.greatest(F.lit(0), F.size(F.split("passage", " ")) - 2))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.char_length(w).alias("n"), w.alias("w"))))["w"]
    p = p.withColumn("word", F.when(F.size(F.split("passage", " ")) >= 3, longest))
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("body"))
    wanted = p.where("word is not null").select("word").distinct()
    words = d.select("doc_id", F.explode(F.array_distinct(F.split("body", " "))).alias("word")).join(wanted, "word")
    near = words.join(p.where("word is not null"), "word").select("doc_id", "item_id").distinct()
    found = (
        near.join(p.select("item_id", "passage"), "item_id").join(d, "doc_id")
        .where(F.contains("body", "passage")).select("item_id", "doc_id")
    )
    short = p.where("word is null and passage <> ''")
    short = short.withColumn("size", F.least(F.char_length("passage"), F.lit(SIGNS)))
    for (size,) in short.select("size").distinct().collect():  # at most SIGNS rows
        mine = short.where(F.col("size") == size).withColumn("run", F.substring("passage", 1, size))
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length("body") - (size - 1)))
        runs = d.select("doc_id", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring("body", i, F.lit(size))))).alias("run"))
        runs = runs.join(mine.select("run").distinct(), "run", "left_semi")
        near = runs.join(mine.select("run", "item_id"), "run").select("doc_id", "item_id").distinct()
        found = found.unionByName(
            near.join(mine.select("item_id", "passage"), "item_id").join(d, "doc_id")
            .where(F.contains("body", "passage")).select("item_id", "doc_id")
        )
    return found


def status(supporting: Column, conflicting: Column, only_web: Column | None = None) -> Column:
    """Status from the numbers of independent supporting and conflicting
    publishers; a single web assertion never supports a claim alone."""
    lone = F.coalesce(only_web, F.lit(False)) if only_web is not None else F.lit(False)
    return (
        F.when((supporting > 0) & (conflicting > 0), "contested")
        .when((supporting >= INDEPENDENT), "supported")
        .when((supporting > 0) & ~lone, "partially_supported")
        .when((supporting > 0) & lone, "unresolved")
        .otherwise("unsupported")
    )


def corroboration(links: DataFrame, docs: DataFrame, passages: DataFrame) -> DataFrame:
    """Per passage: publishers and distinct contents that hold it.

    ``n_contents`` counts equal texts once, so copies by other publishers
    don't corroborate.
    """
    found = links.join(docs.select("doc_id", "source", F.xxhash64("text").alias("content")), "doc_id")
    counted = found.groupBy("item_id").agg(
        F.count_distinct("source").alias("n_publishers"), F.count_distinct("content").alias("n_contents")
    )
    out = passages.select("item_id").join(counted, "item_id", "left").na.fill(0, ["n_publishers", "n_contents"])
    return out.withColumn("status", status(F.col("n_publishers"), F.lit(0)))
