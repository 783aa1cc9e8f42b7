"""Retrieval of knowledge and pages."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import cosine, strip, tokens
from claimloom.operators.shared_terms import NONE, best_documents


def frequent_terms(docs: DataFrame, text_col: str, common: float) -> pa.Array:
    """Terms in more than the share ``common`` of the documents: at most
    1 / ``common`` times the distinct terms of a mean document, so they are
    counted once and gathered."""
    df = docs.select(F.explode(tokens(text_col)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n_docs"))  # one row
    often = df.join(F.broadcast(n), F.col("df") > F.col("n_docs") * common).select("term").toArrow()
    return often.column(0).combine_chunks().cast(NONE.type)


def retrieve(requests: DataFrame, docs: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
             common: float | None = None) -> DataFrame:
    """Top k documents of each request by the number of shared terms.

    ``requests`` has ``request_id`` and ``question``.  Shared terms are
    counted in blocks (``shared_terms``), so nothing grows with the pairs
    of requests and documents but time.  Terms in more than the share
    ``common`` of the documents tell nothing, if given; neither requests
    nor the documents' blocks hold them.
    """
    asked = requests.select("request_id", F.explode(tokens("question")).alias("term"))
    often = NONE if common is None else frequent_terms(docs, text_col, common)
    if len(often):
        asked = asked.join(F.broadcast(docs.sparkSession.createDataFrame(pa.table({"term": often}))), "term", "left_anti")
    hits = best_documents(asked, docs.select(F.col(id_col).alias("id"), tokens(text_col).alias("terms")), k, often)
    w = Window.partitionBy("request_id").orderBy(F.col("n_shared").desc(), F.col("id").asc_nulls_last())
    return (
        hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        .select("request_id", "rank", F.col("id").alias(id_col), "n_shared")
    )


def nearest(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding",
            cell_col: str = "label") -> DataFrame:
    """Top k vectors of the query's own cell by cosine similarity.

    The equality on the cell keeps this an equi-join; scores are rounded
    to nine places so that ties break by id alike everywhere.
    """
    q = queries.select(F.col(id_col).alias("query_id"), F.col(cell_col).alias("cell"), F.col(vector_col).alias("q"))
    c = vectors.select(F.col(id_col).alias(id_col), F.col(cell_col).alias("cell"), F.col(vector_col).alias("v"))
    s = q.join(c, "cell").where(F.col("query_id") != F.col(id_col)).withColumn("score", F.round(cosine("q", "v"), 9))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), id_col)
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", id_col, "score")


def page_text(html: Column | str) -> Column:
    """Readable text of a page: no scripts, styles, comments or tags."""
    c = F.col(html) if isinstance(html, str) else html
    c = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    c = F.regexp_replace(c, r"(?s)<[^>]*>", " ")
    return strip(F.regexp_replace(c, r"[ \t\r\n]+", " "))


def page_title(html: Column | str) -> Column:
    """Text of the title element, empty without one."""
    return strip(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def host(url: Column | str) -> Column:
    """Host of an address."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1))


def web_sources(pages: DataFrame) -> DataFrame:
    """Sources of fetched pages; the page itself is not kept."""
    return pages.select(
        F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("source_id"), F.lit("web").alias("source_type"),
        page_title("html").alias("title"), "url", host("url").alias("publisher"),
    )


def web_excerpts(pages: DataFrame, length: int = 200) -> DataFrame:
    """Evidence of fetched pages: an excerpt of the readable text."""
    return pages.select(
        F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("source_id"), "url",
        F.substring(page_text("html"), 1, length).alias("content"),
    )
