"""Quality and order of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shares of relevance, authority and recency in the order's score.
WEIGHTS = {"relevance": 0.5, "authority": 0.3, "recency": 0.2}


def alphabetic_share(text: Column | str) -> Column:
    """Share of letters and spaces, a stand-in for extraction confidence."""
    kept = F.char_length(F.regexp_replace(text, r"[^A-Za-z ]", ""))
    return F.try_divide(kept.cast("double"), F.char_length(text))


def recency(date: Column | str, as_of: Column, horizon_days: int = 365) -> Column:
    """1 on the day itself, falling to 0 at the horizon; null date: null."""
    age = F.datediff(as_of, date)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - age / F.lit(float(horizon_days))))


def score(weights: dict[str, float] | None = None) -> Column:
    """Weighted mean of the assessed parts; null if none is assessed."""
    w = weights or WEIGHTS
    up = sum((F.coalesce(F.col(k) * v, F.lit(0.0)) for k, v in w.items()), F.lit(0.0))
    down = sum((F.when(F.col(k).isNotNull(), F.lit(v)).otherwise(F.lit(0.0)) for k, v in w.items()), F.lit(0.0))
    return F.try_divide(up, F.when(down > 0, down))


def rank(df: DataFrame, by: str, id_col: str = "evidence_id") -> DataFrame:
    """Evidence in order within ``by``: ``score``, ``rank``; content stays."""
    scored = df.withColumn("score", F.round(score(), 6))
    w = Window.partitionBy(by).orderBy(F.col("score").desc_nulls_last(), id_col)
    return scored.withColumn("rank", F.row_number().over(w))


def top(df: DataFrame, by: str, k: int, id_col: str = "evidence_id") -> DataFrame:
    """The k first of each group (a partial top-k runs before the shuffle)."""
    return rank(df, by, id_col).where(F.col("rank") <= k)
