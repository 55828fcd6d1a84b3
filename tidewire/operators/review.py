"""Editorial review loop: S9, S10, J2, J7, J8, A4-A8, W3, J12, F10, F13, X12."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire import config as C
from tidewire.functions import dates as D
from tidewire.functions import text as T


def read_decisions(sheet: DataFrame) -> DataFrame:
    """Sheet rows -> (row_ord, draft_id, word, status, notes).

    Rows with an empty or non-integer draft id are dropped; the decision cell
    is stripped and upper-cased; ``status`` is NULL for blank/unknown words."""
    words = F.create_map(*[x for w, s in C.APPROVAL_WORDS for x in (F.lit(w), F.lit(s))])
    word = F.upper(T.strip_ws(F.coalesce(F.col("approval"), F.lit(""))))
    return (sheet.select(
        "row_ord",
        F.expr("try_cast(draft_id AS BIGINT)").alias("draft_id"),
        word.alias("word"),
        T.strip_ws(F.coalesce(F.col("notes"), F.lit(""))).alias("notes"))
        .where(F.col("draft_id").isNotNull())
        .withColumn("status", F.element_at(words, F.col("word"))))


def approval_summary(decisions: DataFrame) -> DataFrame:
    """Approved / rejected / edited / skipped over the sheet rows (blank
    and unknown words count as skipped; counted whether or not the guarded
    update changes anything)."""
    s = F.col("status")
    return decisions.agg(
        F.count_if(s == "pending_publisher").alias("approved"),
        F.count_if(s == "rejected").alias("rejected"),
        F.count_if(s == "needs_edit").alias("edited"),
        F.count_if(s.isNull()).alias("skipped"))


def approval_fold(decisions: DataFrame) -> DataFrame:
    """Several decision rows per draft apply in sheet order; ``rejected``
    is absorbing, otherwise the last recognised row wins (with its notes).

    Equivalent closed form: the first rejecting row if any, else the last
    recognised row — two map-side-combinable aggregates, no window, so a
    draft with a huge number of rows is still cheap."""
    rec = decisions.where(F.col("status").isNotNull())
    row = F.struct("row_ord", "status", "notes")
    agg = rec.groupBy("draft_id").agg(
        F.min(F.when(F.col("status") == "rejected", row)).alias("first_reject"),
        F.max(row).alias("last"))
    final = F.coalesce("first_reject", "last")
    return agg.select("draft_id", final["row_ord"].alias("row_ord"),
                      final["status"].alias("status"), final["notes"].alias("notes"))


def apply_decisions(drafts: DataFrame, folded: DataFrame) -> DataFrame:
    """J12 + F13: update status/notes of drafts whose current status is not
    final.  NULL status never updates (three-valued NOT IN)."""
    f = folded.select(F.col("draft_id").alias("id"), F.col("status").alias("_new"),
                      F.col("notes").alias("_notes"))
    j = drafts.join(f, "id", "left")
    upd = F.col("_new").isNotNull() & F.coalesce(~F.col("status").isin(C.FINAL_STATUSES), F.lit(False))
    notes = F.col("editor_notes") if "editor_notes" in drafts.columns else F.lit(None).cast("string")
    j = j.withColumn("updated", upd)
    return (j.withColumn("editor_notes", F.when(F.col("updated"), F.col("_notes")).otherwise(notes))
            .withColumn("status", F.when(F.col("updated"), F.col("_new")).otherwise(F.col("status")))
            .drop("_new", "_notes"))


def not_in_sheet(drafts: DataFrame, sheet: DataFrame) -> DataFrame:
    """Pending drafts whose id is not already in the review sheet."""
    ids = sheet.select(F.expr("try_cast(draft_id AS BIGINT)").alias("id")).where(F.col("id").isNotNull())
    return drafts.where(F.col("status") == "pending_editor").join(ids, "id", "left_anti")


def _members(drafts: DataFrame, articles: DataFrame) -> DataFrame:
    """explode the id list, one equi join with the article store."""
    ex = drafts.select(F.col("id").alias("draft_id"), F.explode("raw_article_ids").alias("aid"))
    a = articles.select(F.col("id").alias("aid"), "source", "url")
    return ex.join(a, "aid")


def source_lists(drafts: DataFrame, articles: DataFrame) -> DataFrame:
    """J8 + A4: per draft the distinct sources joined by `` + `` (sorted) and
    the urls joined by newlines (article id order).  Drafts with no ids get
    empty strings."""
    m = _members(drafts, articles)
    agg = m.groupBy("draft_id").agg(
        F.array_join(F.array_sort(F.collect_set("source")), " + ").alias("sources"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("aid", "url"))), lambda x: x["url"]),
                     "\n").alias("source_urls"))
    return (drafts.select("id").join(agg.withColumnRenamed("draft_id", "id"), "id", "left")
            .select("id", F.coalesce("sources", F.lit("")).alias("sources"),
                    F.coalesce("source_urls", F.lit("")).alias("source_urls")))


def review_rows(drafts: DataFrame, articles: DataFrame, sheet: DataFrame) -> DataFrame:
    """The 12 review-sheet columns for pending drafts not yet exported."""
    new = not_in_sheet(drafts, sheet)
    src = source_lists(new, articles)
    return new.join(src, "id").select(
        F.col("id").alias("draft_id"),
        D.minute_stamp("created_at").alias("date_generated"),
        F.coalesce("category", F.lit("")).alias("category"),
        F.coalesce("headline", F.lit("")).alias("headline"),
        F.coalesce("seo_description", F.lit("")).alias("seo_description"),
        T.html_to_readable("body").alias("body"),
        T.word_count("body").alias("word_count"),
        "sources", "source_urls",
        F.lit("").alias("approval"), F.lit("").alias("editor_notes"),
        F.when(F.coalesce(F.col("wp_post_id"), F.lit(0)) != 0, F.col("wp_post_id").cast("string"))
         .otherwise(F.lit("")).alias("wp_post_id"))


def preview(drafts: DataFrame, articles: DataFrame) -> DataFrame:
    """J7 + A5: pending drafts with all member sources joined by `` + ``
    (repeats kept) and urls joined by ``|||`` in article id order; drafts
    with no matching article keep NULLs (left outer)."""
    pending = drafts.where(F.col("status") == "pending_editor")
    m = _members(pending, articles)
    agg = m.groupBy("draft_id").agg(
        F.sort_array(F.collect_list(F.struct("aid", "source", "url"))).alias("_m"))
    return (pending.join(agg.withColumnRenamed("draft_id", "id"), "id", "left")
            .select("id", "headline", "category", "status",
                    F.array_join(F.transform("_m", lambda x: x["source"]), " + ").alias("sources"),
                    F.array_join(F.transform("_m", lambda x: x["url"]), "|||").alias("source_urls")))


def status_counts(drafts: DataFrame) -> DataFrame:
    """A6."""
    return drafts.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def frequent_rejections(rejections: DataFrame, min_count: int = 3) -> DataFrame:
    """Rejection reasons seen at least ``min_count`` times."""
    return (rejections.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= min_count))


def by_status(drafts: DataFrame, status: str) -> DataFrame:
    """drafts in one status that already have a post id."""
    return drafts.where((F.col("status") == status) & (F.coalesce(F.col("wp_post_id"), F.lit(0)) != 0))


def notice_rows(drafts: DataFrame, statuses=("pending_editor", "pending_publisher"),
                edit_url: str = "https://cms.example.com/edit?post=") -> DataFrame:
    """One notice line per draft (newest first within a status) with the
    count of its status.  Items stay rows — a status holding a third of all
    drafts is never gathered into one list; counts come from a map-side
    combined aggregate joined back on the (enum-bounded) status key."""
    sel = drafts.where(F.col("status").isin(list(statuses))
                       & (F.coalesce(F.col("wp_post_id"), F.lit(0)) != 0))
    counts = sel.groupBy("status").agg(F.count(F.lit(1)).alias("n_status"))
    return sel.join(F.broadcast(counts), "status").select(
        "status", "n_status", "id", "headline", "category",
        T.substr_cap(F.coalesce("seo_description", F.lit("")), 90).alias("description"),
        F.concat(F.lit(edit_url), F.col("wp_post_id").cast("string")).alias("link"))
