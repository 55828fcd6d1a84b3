"""Ranking: A2 group sizes, J4/J5 lookups, M1-M6 scores, O1 top stories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire import config as C
from tidewire.functions import scoring as S


def group_sizes(grouped: DataFrame) -> DataFrame:
    """A2: rows per non-empty story group."""
    return (grouped.where(F.col("story_group_id").isNotNull())
            .groupBy("story_group_id").agg(F.count(F.lit(1)).alias("group_size")))


def score(grouped: DataFrame, as_of: Column, authority: DataFrame,
          boosted=C.BOOSTED_CATEGORIES) -> DataFrame:
    """M1-M6 over anchors (``is_duplicate = 0``; ungrouped rows pass too).

    J4 is the ``group_size`` that the grouping gives, or a join of the
    per-group sizes where it is not there; J5 joins the authority table (the
    planner picks the join)."""
    anchors = grouped.where(F.coalesce(F.col("is_duplicate"), F.lit(0)) == 0)
    if "group_size" not in grouped.columns:
        anchors = anchors.join(group_sizes(grouped), "story_group_id", "left")
    j = anchors.join(authority, "source", "left")
    return (j.withColumn("recency", S.recency_score("published_at", as_of))
            .withColumn("authority", S.authority_score("weight"))
            .withColumn("bonus", S.group_bonus("group_size"))
            .withColumn("boost", S.category_boost("category", boosted))
            .withColumn("priority_score", S.priority_score("recency", "authority", "bonus", "boost"))
            .withColumn("is_multi_source", F.col("story_group_id").isNotNull()
                        & (F.coalesce(F.col("group_size"), F.lit(1)) > 1))
            .drop("weight"))


def top_stories(scored: DataFrame, n: int = C.TOP_N) -> DataFrame:
    """O1: score desc, id asc on ties, first n (TakeOrderedAndProject)."""
    return scored.orderBy(F.col("priority_score").desc(), F.col("id").asc()).limit(n)
