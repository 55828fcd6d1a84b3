"""Category routing and post payloads: J9, X7, X8, F8."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire import config as C


def _lookup_ids(categories: DataFrame, merged: bool) -> DataFrame:
    """(key, cat_id) lookup over lower-cased names and slugs.

    Separate dictionaries (``merged=False``): a name entry wins over a slug
    entry.  One merged dictionary (``merged=True``, the link-request copy of
    the routing): entries are written category by category, slug after name,
    so the last written wins."""
    names = categories.select(F.lower("name").alias("key"), F.col("id"), F.lit(0).alias("pri"))
    slugs = categories.select(F.lower("slug").alias("key"), F.col("id"), F.lit(1).alias("pri"))
    both = names.unionByName(slugs)
    order = (F.struct(F.col("id").alias("a"), F.col("pri").alias("b"), F.col("id").alias("id")) if merged
             else F.struct((-F.col("pri")).alias("a"), F.col("id").alias("b"), F.col("id").alias("id")))
    return both.groupBy("key").agg(F.max(order).alias("_b")).select("key", F.col("_b.id").alias("cat_id"))


def route_categories(df: DataFrame, categories: DataFrame, category_col: str = "category",
                     mapping=C.CATEGORY_MAP, merged: bool = False, keep_lookup: bool = False) -> DataFrame:
    """X7 + J9: ``category_ids`` = [primary section id if known] + [mapped
    topic id unless blocked, unknown or already present].  Unmapped names are
    looked up as they are.  An id of 0 counts as missing (falsy in the
    behaviour reproduced).  The lookup is config-sized: broadcast after a
    size check; the primary id is one value read from it."""
    lk = _lookup_ids(categories, merged)
    prim_row = lk.where(F.col("key") == C.PRIMARY_SECTION).select("cat_id").first()
    prim_val = prim_row[0] if prim_row and prim_row[0] else None
    prim_id = F.lit(prim_val).cast("bigint")
    mp = F.create_map(*[x for a, b in mapping for x in (F.lit(a), F.lit(b))])
    low = F.lower(F.coalesce(F.col(category_col), F.lit("")))
    x = df.withColumn("_mapped", F.coalesce(F.element_at(mp, low), low))
    x = x.join(lk.select(F.col("key").alias("_mapped"), F.col("cat_id").alias("_sub")), "_mapped", "left")
    sub_ok = ((F.col("_mapped") != "") & ~F.col("_mapped").isin(C.BLOCKED_SECTIONS)
              & (F.coalesce(F.col("_sub"), F.lit(0)) != 0)
              & (prim_id.isNull() | (F.col("_sub") != prim_id)))
    ids = F.filter(F.array(prim_id, F.when(sub_ok, F.col("_sub"))), lambda v: v.isNotNull())
    x = x.withColumn("category_ids", ids.cast("array<bigint>"))
    if keep_lookup:
        return x.withColumnRenamed("_mapped", "mapped_name").withColumnRenamed("_sub", "topic_id")
    return x.drop("_mapped", "_sub")


def unpublished(drafts: DataFrame, status: str = "pending_editor") -> DataFrame:
    """F8: drafts in ``status`` without a post id (NULL or 0)."""
    return drafts.where((F.col("status") == status) & (F.coalesce(F.col("wp_post_id"), F.lit(0)) == 0))


def post_payload(df: DataFrame, tag_id: int = C.GENERATED_TAG_ID,
                 attribution_col: str = "seo_description") -> DataFrame:
    """Title, content (body + attribution paragraph), status ``draft``,
    excerpt, categories (+ newsletter section), one tag, optional image."""
    attribution = F.concat(F.lit("\n\n<p><em>Source(s): "), F.coalesce(F.col(attribution_col), F.lit("")),
                           F.lit("</em></p>"))
    cats = F.col("category_ids")
    cats = F.when(F.array_contains(cats, F.lit(C.NEWSLETTER_SECTION_ID).cast("bigint")), cats) \
        .otherwise(F.concat(cats, F.array(F.lit(C.NEWSLETTER_SECTION_ID).cast("bigint"))))
    img: Column = F.col("wp_image_id") if "wp_image_id" in df.columns else F.lit(None).cast("bigint")
    return df.select(
        "id",
        F.col("headline").alias("title"),
        F.concat(F.coalesce(F.col("body"), F.lit("")), attribution).alias("content"),
        F.lit("draft").alias("status"),
        F.coalesce(F.col("seo_description"), F.lit("")).alias("excerpt"),
        cats.alias("categories"),
        F.array(F.lit(tag_id).cast("bigint")).alias("tags"),
        F.when(F.coalesce(img, F.lit(0)) != 0, img).alias("featured_media"))
