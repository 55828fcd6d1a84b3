"""Image choice: X1 keyword lists, J10/W4/A11 best media per draft, F7."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import text as T


def keyword_list(keywords_json, headline, category, with_category: bool = True) -> Column:
    """JSON list -> first 3; bad JSON -> empty; empty -> up to three
    headline words longer than 4 chars (+ the category for drafts)."""
    parsed = F.from_json(F.col(keywords_json) if isinstance(keywords_json, str) else keywords_json,
                         "array<string>")
    first3 = F.slice(F.coalesce(parsed, F.array().cast("array<string>")), 1, 3)
    fallback = T.headline_words(headline)
    if with_category:
        fallback = F.concat(fallback, F.array(F.coalesce(F.col(category) if isinstance(category, str)
                                                         else category, F.lit(""))))
    return F.when(F.size(first3) > 0, first3).otherwise(fallback)


def needs_image(drafts: DataFrame) -> DataFrame:
    """drafts without an image id (NULL or 0)."""
    return drafts.where(F.coalesce(F.col("wp_image_id"), F.lit(0)) == 0)


def best_media(drafts: DataFrame, media: DataFrame, photos: DataFrame, k: int = 3) -> DataFrame:
    """Per draft, the first keyword (in list order) with a media-library
    hit takes the first hit (lowest id); else the most-downloaded photo that
    matches any of the first ``k`` keywords (missing downloads count 0, the
    first photo wins ties); else none.

    A hit is lower-cased token equality between keyword and title word.  The
    catalogues are reduced to one best row per token *before* the join, so a
    token shared by a third of the catalogue costs one row, not a third of the
    catalogue per draft."""
    kw = drafts.select("id", F.posexplode(F.slice("keywords", 1, k)).alias("pos", "kw")) \
        .select("id", "pos", F.lower("kw").alias("tok"))
    mtok = (media.select(F.col("id").alias("media_id"),
                         F.explode(F.split(F.lower(F.col("title.rendered")), "\\s+")).alias("tok"))
            .where(F.col("tok") != "")
            .groupBy("tok").agg(F.min("media_id").alias("media_id")))
    ptok = (photos.select(
                F.coalesce(F.col("downloads"), F.lit(0)).alias("d"), (-F.col("ord")).alias("no"),
                F.col("id").alias("pid"),
                F.explode(F.split(F.lower(F.col("description")), "\\s+")).alias("tok"))
            .where(F.col("tok") != "")
            .groupBy("tok").agg(F.max(F.struct("d", "no", "pid")).alias("p")))
    j = kw.join(mtok, "tok", "left").join(ptok, "tok", "left")
    per = j.groupBy("id").agg(
        F.min(F.when(F.col("media_id").isNotNull(), F.struct("pos", "media_id"))).alias("m"),
        F.max("p").alias("p"))
    out = drafts.select("id").join(per, "id", "left")
    return out.select(
        "id",
        F.col("m.media_id").alias("media_id"),
        F.when(F.col("m").isNull(), F.col("p.pid")).alias("photo_id"),
        F.when(F.col("m").isNotNull(), F.lit("library"))
         .when(F.col("p").isNotNull(), F.lit("photo")).otherwise(F.lit("none")).alias("origin"))
