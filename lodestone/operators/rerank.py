"""Reranking of fused candidates by metadata, names and keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.analysis import ARCHITECTURAL_TYPES
from ..functions.text import bound
from .search import LIMIT, top

# What each agreement adds to the score.
SERVICE, FILE_TYPE, ENTITY, ARCHITECTURAL, KEYWORD = 0.2, 0.15, 0.1, 0.1, 0.05


def first_of_each(df: DataFrame, *order, keys=("query_id", "id")) -> DataFrame:
    """One row of each key: the first in the order given."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


WANTS = ["keywords", "entityNames", "serviceFilter", "fileTypeFilter", "isArchitectural"]


def boost(lowered: Column | None = None) -> Column:
    """What a candidate (content, serviceName, fileType) gains under its question's analysis."""
    # The text is lower-cased once, not for each word.
    held = lambda words: F.size(bound(F.lower(F.col("content")) if lowered is None else lowered, lambda text: F.filter(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.contains(text, F.lower(w)))))
    return (
        F.when(F.col("serviceName") == F.col("serviceFilter"), SERVICE).otherwise(0.0)
        + F.when(F.col("fileType") == F.col("fileTypeFilter"), FILE_TYPE).otherwise(0.0)
        + held(F.col("entityNames")) * ENTITY
        + F.when(F.col("isArchitectural") & F.col("fileType").isin(ARCHITECTURAL_TYPES), ARCHITECTURAL).otherwise(0.0)
        + held(F.col("keywords")) * KEYWORD
    )


def with_boost(candidates: DataFrame, analysis: DataFrame, texts: DataFrame) -> DataFrame:
    """Candidates (query_id, id, serviceName, fileType ...) with `boost`. The texts (id, content) are
    lower-cased once each, meet their candidates here and go no further."""
    lowered = texts.select("id", F.lower("content").alias("__lowered"))
    both = candidates.join(analysis.select("query_id", *WANTS), "query_id").join(lowered, "id")
    return both.select(*candidates.columns, boost(F.col("__lowered")).alias("boost"))


def normalised(score: Column, by: str = "query_id") -> Column:
    """Between the least and the greatest score of a question; 1 if all are equal."""
    w = Window.partitionBy(by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high == low, 1.0).otherwise((score - low) / (high - low))


def rerank(candidates: DataFrame, analysis: DataFrame, limit: int = LIMIT, decimals: int = 9) -> DataFrame:
    """The best `limit` candidates (query_id, id, score, rank, content, serviceName, fileType) of each
    question under its analysis, with new scores and ranks; ties keep their order. Candidates may have
    their `boost` instead of content.

    Scores are rounded to `decimals` before they are compared, so that sums made in another order
    can't change the ranking."""
    once = first_of_each(candidates, "rank").withColumnRenamed("rank", "position")
    if "boost" in candidates.columns:
        gained = once.withColumn("score", F.round(F.col("score") + F.col("boost"), decimals)).drop("boost")
    else:
        gained = once.join(analysis.select("query_id", *WANTS), "query_id").withColumn("score", F.round(F.col("score") + boost(), decimals)).drop(*WANTS)
    scored = gained.withColumn("score", F.round(normalised(F.col("score")), decimals))
    return top(scored, limit, F.desc("score"), "position")
