"""Digests: F11 posts of the day per section, O2 top-k per section, X11 text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire import config as C
from tidewire.functions import dates as D
from tidewire.functions import text as T

# Digest layout: a title line, then numbered entries of title, excerpt and link.
SECTION_TITLES = {"morning": "Morning round-up", "evening": "Evening reading"}
FOOTER = "(end of digest)"


def posts_by_section(posts: DataFrame, as_of: Column, sections=C.DIGEST_SECTIONS) -> DataFrame:
    """F11 + J11: published posts dated strictly after the UTC midnight of
    ``as_of`` whose categories overlap a section's ids; one row per
    (section, post).  The section config is inlined: no join."""
    secs = F.array(*[F.struct(F.lit(n).alias("section"), F.array(*[F.lit(i) for i in ids]).cast("array<bigint>")
                              .alias("ids")) for n, ids in sections])
    live = posts.where((F.col("status") == "publish") & (F.col("date") > D.day_start(as_of)))
    hit = F.filter(secs, lambda s: F.arrays_overlap(F.col("categories").cast("array<bigint>"), s["ids"]))
    return live.select("*", F.explode(hit).alias("_s")).withColumn("section", F.col("_s.section")).drop("_s")


def top_per_section(rows: DataFrame, limits=C.DIGEST_LIMITS) -> DataFrame:
    """O2: newest first (id desc on ties), at most the section's limit.
    The rank filter is planned as a WindowGroupLimit, so each partition keeps
    only its local top-k before the section shuffle."""
    lim = F.element_at(F.create_map(*[x for n, k in limits for x in (F.lit(n), F.lit(k))]), F.col("section"))
    w = Window.partitionBy("section").orderBy(F.col("date").desc(), F.col("id").desc())
    return (rows.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= max(k for _, k in limits))
            .where(F.col("rank") <= lim))


def digest_text(top: DataFrame, as_of: Column) -> DataFrame:
    """X11: one text per section: header (section title, long date), one
    entry per post in rank order (cleaned title, cleaned and truncated
    excerpt, link), footer.  At most ``limit`` entries are gathered."""
    entry = F.concat(F.col("rank").cast("string"), F.lit(") "), T.decode_entities("title.rendered"), F.lit("\n   "),
                     T.truncate_word(T.decode_entities("excerpt.rendered")), F.lit("\n   <"),
                     F.col("link"), F.lit(">\n"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", entry.alias("e")))),
                                    lambda x: x["e"]), "")
    titles = F.create_map(*[x for k, v in SECTION_TITLES.items() for x in (F.lit(k), F.lit(v))])
    header = F.concat(F.element_at(titles, F.col("section")), F.lit(", "), D.long_date(as_of), F.lit("\n"))
    return (top.groupBy("section").agg(body.alias("_body"), F.count(F.lit(1)).alias("n_posts"))
            .select("section", "n_posts", F.concat(header, F.col("_body"), F.lit(FOOTER)).alias("text")))
