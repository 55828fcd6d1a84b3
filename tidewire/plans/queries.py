"""Registered queries: one per operator of the inventory, each over the
derived fixture tables of ``tidewire.sources.fixtures``.

Every callable takes (spark, sf_dir) and returns a DataFrame whose column
names match the DuckDB oracle in ``tidewire.plans.oracle``.  Timestamps are
rendered as ``yyyy-MM-dd HH:mm:ss`` text and arrays as joined text so that both
engines hash the same values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire import config as C
from tidewire.functions import dates as D
from tidewire.functions import text as T
from tidewire.operators import ingest as I
from tidewire.operators import ranking as R
from tidewire.operators import similarity as G
from tidewire.sources import fixtures as X

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


def _ts(c) -> F.Column:
    return D.iso_seconds(c)


# ---------------------------------------------------------------------------
# pipeline building blocks shared by several queries
# ---------------------------------------------------------------------------

def ingested(spark: SparkSession, sf: str) -> DataFrame:
    """The day's article snapshot (W1 F1 F2 F3 A1), materialised once in the
    checkpoint folder: it is the first of the pipeline's three
    materialisation points (snapshot, story groups, drafts), and every later
    stage reads it several times."""
    from tidewire.session import materialize
    return materialize(I.ingest(X.articles(spark, sf), X.as_of()), "snapshot")


def ingested_narrow(spark: SparkSession, sf: str) -> DataFrame:
    """The same rows without their texts: grouping and ranking need no more."""
    from tidewire.session import materialize
    return materialize(I.ingest(X.articles(spark, sf), X.as_of(), narrow=True), "snapshot")


def grouped(spark: SparkSession, sf: str) -> DataFrame:
    return G.story_groups(ingested_narrow(spark, sf), X.as_of())


def scored(spark: SparkSession, sf: str) -> DataFrame:
    from tidewire.config import authority_df
    return R.score(grouped(spark, sf), X.as_of(), authority_df(spark))


# ---------------------------------------------------------------------------
# ingest: W1 F1 F2 F3 A1 S2 A9 S5 J1
# ---------------------------------------------------------------------------

@query("w1_first_seen")
def w1_first_seen(spark, sf):
    a = X.articles(spark, sf)
    return I.first_seen(a).select("id", "url", "source")


@query("f1_has_link")
def f1_has_link(spark, sf):
    return I.has_link(X.feed_items(spark, sf), "link").select("id", "link")


@query("f2_fresh")
def f2_fresh(spark, sf):
    return I.fresh(X.articles(spark, sf), X.as_of()).select("id", _ts("published_at").alias("published_at"))


@query("f3_relevant")
def f3_relevant(spark, sf):
    return I.relevant(X.articles(spark, sf)).select("id")


@query("a1_category_scores")
def a1_category_scores(spark, sf):
    return I.classify(X.articles(spark, sf)).select("id", "category")


@query("s2_article_snapshot")
def s2_article_snapshot(spark, sf):
    return ingested(spark, sf).select(
        "id", "url", "url_hash", "source", "title", _ts("published_at").alias("published_at"),
        _ts("fetched_at").alias("fetched_at"), "category")


@query("a9_ingest_counts")
def a9_ingest_counts(spark, sf):
    return I.per_source_counts(ingested_narrow(spark, sf))


@query("s5_insert_if_absent")
def s5_insert_if_absent(spark, sf):
    return I.insert_if_absent(ingested_narrow(spark, sf), X.store(spark, sf)).select("id", "url")


@query("a9_insert_counts")
def a9_insert_counts(spark, sf):
    batch = ingested_narrow(spark, sf)
    return I.insert_counts(batch, I.insert_if_absent(batch, X.store(spark, sf)))


# ---------------------------------------------------------------------------
# grouping: F4 P3 J3 G1 G2 W2 A3
# ---------------------------------------------------------------------------

def _window(spark, sf):
    cutoff = F.timestamp_seconds(F.unix_seconds(X.as_of()) - C.LOOKBACK_HOURS * 3600)
    return ingested_narrow(spark, sf).where(F.col("fetched_at") >= cutoff)


@query("f4_lookback")
def f4_lookback(spark, sf):
    """Stored snapshots of several days, of which only those of the look-back
    range are listed and read."""
    from tidewire.session import AS_OF
    from tidewire.sources import io as IO
    root = IO.scratch_dir(spark, "days")
    snap = I.ingest(X.articles(spark, sf), X.as_of()).select(*[c.split()[0] for c in IO.SNAPSHOT_SCHEMA.split(", ")])
    IO.write_snapshot_days(snap, root)
    return IO.read_window(spark, root, AS_OF, C.LOOKBACK_HOURS).select("id", _ts("fetched_at").alias("fetched_at"))


@query("p3_title_tokens")
def p3_title_tokens(spark, sf):
    s = G.token_sets(X.articles(spark, sf))
    return s.select("id", F.array_join("tokens", " ").alias("tokens"), "n")


@query("j3_similar_pairs")
def j3_similar_pairs(spark, sf):
    narrow = G.window_narrow(ingested_narrow(spark, sf), X.as_of())
    reps, _ = G.collapse_copies(G.token_sets(narrow))
    from tidewire.session import materialize
    return G.similar_pairs(materialize(reps, "title-sets"))


@query("g1_connected_components")
def g1_connected_components(spark, sf):
    return G.story_components(G.window_narrow(ingested_narrow(spark, sf), X.as_of()))


@query("g2_story_groups")
def g2_story_groups(spark, sf):
    return grouped(spark, sf).select("id", "story_group_id", "is_duplicate")


@query("w2_group_anchor")
def w2_group_anchor(spark, sf):
    return grouped(spark, sf).where(F.col("is_duplicate") == 0).select(
        "story_group_id", F.col("id").alias("anchor_id"))


@query("a3_group_stats")
def a3_group_stats(spark, sf):
    return G.group_stats(grouped(spark, sf))


# ---------------------------------------------------------------------------
# ranking: A2 M1-M6 O1
# ---------------------------------------------------------------------------

@query("a2_group_sizes")
def a2_group_sizes(spark, sf):
    return R.group_sizes(grouped(spark, sf))


@query("m5_priority_score")
def m5_priority_score(spark, sf):
    return scored(spark, sf).select("id", "recency", "authority", "bonus", "boost",
                                    "priority_score", "is_multi_source")


@query("o1_top_stories")
def o1_top_stories(spark, sf):
    return R.top_stories(scored(spark, sf)).select(
        "id", "title", "source", "category", "story_group_id", "priority_score", "is_multi_source")


# ---------------------------------------------------------------------------
# shared derived inputs for the later stages
# ---------------------------------------------------------------------------

from tidewire.functions import scoring as S  # noqa: E402
from tidewire.operators import digest as DG  # noqa: E402
from tidewire.operators import drafting as DR  # noqa: E402
from tidewire.operators import media as MD  # noqa: E402
from tidewire.operators import requests as RQ  # noqa: E402
from tidewire.operators import review as RV  # noqa: E402
from tidewire.operators import routing as RT  # noqa: E402
from tidewire.operators import videos as VD  # noqa: E402


def _list(c, sep=","):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), sep)


def _decisions(spark, sf):
    return RV.read_decisions(X.review_sheet(spark, sf))


def _top_with_text(spark, sf):
    """top stories joined back to their text columns; members likewise."""
    from tidewire.config import authority_df
    g = grouped(spark, sf)
    top = R.top_stories(R.score(g, X.as_of(), authority_df(spark)))
    text = X.articles(spark, sf).select("id", "summary", "raw_content")
    members = g.select("id", "story_group_id", "source", "title").join(text, "id")
    return top.join(text, "id"), members


# ---------------------------------------------------------------------------
# scalar projections over fixture tables: P1 P2 P5-P13 P15, D1 D3-D6
# ---------------------------------------------------------------------------

@query("p1_url_hash")
def p1_url_hash(spark, sf):
    return X.articles(spark, sf).select("id", "url", T.url_hash("url").alias("url_hash"))


@query("p2_strip_ws")
def p2_strip_ws(spark, sf):
    return X.feed_items(spark, sf).select("id", T.strip_ws("title").alias("title"))


@query("p5_clean_text")
def p5_clean_text(spark, sf):
    return X.drafts(spark, sf).select("id", T.clean_text("body").alias("text"))


@query("p6_html_to_readable")
def p6_html_to_readable(spark, sf):
    return X.drafts(spark, sf).select("id", T.html_to_readable("body").alias("readable"))


@query("p7_word_count")
def p7_word_count(spark, sf):
    return X.drafts(spark, sf).select("id", T.word_count("body").alias("word_count"))


@query("p8_decode_entities")
def p8_decode_entities(spark, sf):
    p = X.table(spark, sf, "pages")
    return p.select("page_id", T.decode_entities(
        F.regexp_extract("html", "<title>(.*?)</title>", 1)).alias("title"))


@query("p9_truncate_word")
def p9_truncate_word(spark, sf):
    return X.cms_posts(spark, sf).select(
        "id", T.truncate_word(T.decode_entities("excerpt.rendered")).alias("excerpt"))


@query("p10_substr_caps")
def p10_substr_caps(spark, sf):
    return X.drafts(spark, sf).select(
        "id", T.substr_cap("seo_description", 90).alias("desc90"),
        F.concat(T.substr_cap("body", 200), F.lit("...")).alias("body_preview"))


@query("p12_title_case")
def p12_title_case(spark, sf):
    r = RQ.pending_requests(X.link_requests(spark, sf))
    v = r.select("row_ord", S.validate_override("category_override").alias("v"))
    return v.where(F.col("v.key").isNotNull()).select("row_ord", T.title_case("v.key").alias("category"))


@query("p13_url_domain")
def p13_url_domain(spark, sf):
    return X.table(spark, sf, "pages").select("page_id", T.url_domain("url").alias("domain"))


@query("p15_headline_words")
def p15_headline_words(spark, sf):
    return X.drafts(spark, sf).select("id", F.array_join(T.headline_words("headline"), "|").alias("words"))


@query("d1_parse_published")
def d1_parse_published(spark, sf):
    f = X.feed_items(spark, sf)
    return f.select("id", "published", _ts(D.parse_published("published")).alias("published_at"))


@query("d3_age_hours")
def d3_age_hours(spark, sf):
    a = X.articles(spark, sf)
    return a.select("id", F.round(D.age_hours("published_at", X.as_of()), 3).alias("age_hours"))


@query("d4_minute_stamp")
def d4_minute_stamp(spark, sf):
    return X.drafts(spark, sf).select("id", D.minute_stamp("created_at").alias("created"))


@query("d5_long_date")
def d5_long_date(spark, sf):
    return X.cms_posts(spark, sf).select("id", D.long_date("date").alias("long_date"),
                                         _ts(D.day_start("date")).alias("day_start"))


# ---------------------------------------------------------------------------
# filters F5-F13
# ---------------------------------------------------------------------------

@query("f5_ungrouped")
def f5_ungrouped(spark, sf):
    a = X.articles(spark, sf).withColumn(
        "story_group_id", F.when(F.col("id") % 5 == 0, F.col("id")))
    return a.where(F.col("story_group_id").isNull()).select("id")


@query("f6_anchors_only")
def f6_anchors_only(spark, sf):
    return grouped(spark, sf).where(F.col("is_duplicate") == 0).select("id")


@query("f7_needs_image")
def f7_needs_image(spark, sf):
    return MD.needs_image(X.drafts(spark, sf)).select("id")


@query("f8_unpublished")
def f8_unpublished(spark, sf):
    return RT.unpublished(X.drafts(spark, sf)).select("id")


@query("f10_by_status")
def f10_by_status(spark, sf):
    return RV.by_status(X.drafts(spark, sf), "pending_editor").select("id", "headline")


@query("f13_not_terminal")
def f13_not_terminal(spark, sf):
    d = X.drafts(spark, sf)
    return d.where(~F.col("status").isin(C.FINAL_STATUSES)).select("id", "status")


# ---------------------------------------------------------------------------
# review loop: S10 A8 W3 J12 J2 J8/A4/S9 J7/A5 A6 A7 X12
# ---------------------------------------------------------------------------

@query("s10_review_sheet_read")
def s10_review_sheet_read(spark, sf):
    return _decisions(spark, sf).select("row_ord", "draft_id", "word", "status", "notes")


@query("a8_approval_summary")
def a8_approval_summary(spark, sf):
    return RV.approval_summary(_decisions(spark, sf))


@query("w3_approval_fold")
def w3_approval_fold(spark, sf):
    return RV.approval_fold(_decisions(spark, sf))


@query("j12_apply_decisions")
def j12_apply_decisions(spark, sf):
    out = RV.apply_decisions(X.drafts(spark, sf), RV.approval_fold(_decisions(spark, sf)))
    return out.select("id", "status", "editor_notes", "updated")


@query("j2_not_in_sheet")
def j2_not_in_sheet(spark, sf):
    return RV.not_in_sheet(X.drafts(spark, sf), X.review_sheet(spark, sf)).select("id")


@query("j8_review_rows")
def j8_review_rows(spark, sf):
    return RV.review_rows(X.drafts(spark, sf), X.articles(spark, sf), X.review_sheet(spark, sf))


@query("j7_preview")
def j7_preview(spark, sf):
    return RV.preview(X.drafts(spark, sf), X.articles(spark, sf))


@query("a6_status_counts")
def a6_status_counts(spark, sf):
    return RV.status_counts(X.drafts(spark, sf))


@query("a7_frequent_rejections")
def a7_frequent_rejections(spark, sf):
    e = X.table(spark, sf, "events").where(F.col("event_type") == "error")
    rej = e.select(F.concat(F.lit("reason "), (F.get_json_object("props", "$.k").cast("bigint") % 5)
                            .cast("string")).alias("reason"))
    return RV.frequent_rejections(rej)


@query("x12_notice_list")
def x12_notice_list(spark, sf):
    return RV.notice_rows(X.drafts(spark, sf))


# ---------------------------------------------------------------------------
# drafting: J6 O4 X2 X5 X3 X4 S12 S7 S8
# ---------------------------------------------------------------------------

@query("j6_group_members")
def j6_group_members(spark, sf):
    top, members = _top_with_text(spark, sf)
    return DR.group_members(top, members).select("story_id", "member_id")


@query("x5_story_prompt")
def x5_story_prompt(spark, sf):
    top, members = _top_with_text(spark, sf)
    p = DR.story_prompts(top, members)
    return p.select("story_id", "n_sources", _list(F.col("raw_article_ids")).alias("raw_article_ids"), "prompt")


@query("x3_parse_model_json")
def x3_parse_model_json(spark, sf):
    p = DR.parse_answers(X.model_responses(spark, sf))
    ok = F.col("ok")
    return p.select("request_id", "ok", *[F.when(ok, F.col(c)).alias(c) for c in
                                          ("headline", "body", "category", "seo_description",
                                           "source_attribution")],
                    F.when(ok, F.array_join("image_keywords", ",")).alias("image_keywords"))


@query("s12_draft_summary")
def s12_draft_summary(spark, sf):
    s = DR.draft_summary(DR.parse_answers(X.model_responses(spark, sf)))
    return s.withColumn("image_keywords", F.array_join("image_keywords", ","))


@query("s8_evolve_schema")
def s8_evolve_schema(spark, sf):
    from tidewire.sources.io import evolve_union
    old = X.drafts(spark, sf).drop("image_keywords")
    new = DR.new_draft_rows(DR.parse_answers(X.model_responses(spark, sf)), X.as_of())
    u = evolve_union(old.select("id", "headline", "status"), new.select("id", "headline", "status",
                                                                      "image_keywords"))
    return u.groupBy("status").agg(F.count(F.lit(1)).alias("n"),
                                   F.count("image_keywords").alias("with_keywords"))


# ---------------------------------------------------------------------------
# media: X1 J10/W4/A11
# ---------------------------------------------------------------------------

def _with_keywords(spark, sf):
    d = X.drafts(spark, sf)
    return d.withColumn("keywords", MD.keyword_list("image_keywords", "headline", "category"))


@query("x1_keyword_cap")
def x1_keyword_cap(spark, sf):
    return _with_keywords(spark, sf).select("id", F.array_join("keywords", "|").alias("keywords"))


@query("j10_best_media")
def j10_best_media(spark, sf):
    d = MD.needs_image(_with_keywords(spark, sf))
    b = MD.best_media(d, X.media(spark, sf), X.photos(spark, sf))
    return b.withColumn("media_id", F.col("media_id").cast("string"))


# ---------------------------------------------------------------------------
# routing: J9 X7 X8
# ---------------------------------------------------------------------------

@query("x7_route_categories")
def x7_route_categories(spark, sf):
    d = RT.route_categories(RT.unpublished(X.drafts(spark, sf)), X.cms_categories(spark, sf))
    return d.select("id", "category", _list(F.col("category_ids")).alias("category_ids"))


@query("x8_post_payload")
def x8_post_payload(spark, sf):
    d = RT.route_categories(RT.unpublished(X.drafts(spark, sf)), X.cms_categories(spark, sf))
    p = RT.post_payload(d)
    return p.select("id", "title", "content", "status", "excerpt",
                    _list(F.col("categories")).alias("categories"), _list(F.col("tags")).alias("tags"),
                    F.col("featured_media").cast("string").alias("featured_media"))


# ---------------------------------------------------------------------------
# link requests: F9 M7/J13 M8 M9 X9 X10 X13 X6
# ---------------------------------------------------------------------------

def _pending(spark, sf):
    return RQ.pending_requests(X.link_requests(spark, sf))


def _outcomes(spark, sf):
    pend = _pending(spark, sf)
    pages = X.table(spark, sf, "pages").join(pend.select("url").distinct(), "url", "left_semi")
    return RQ.request_outcomes(pend, X.domain_rules(spark, sf), X.fetch_results(spark, sf),
                               RQ.extract_main_text(pages), RQ.embed_text(X.embeds(spark, sf)))


@query("f9_pending_requests")
def f9_pending_requests(spark, sf):
    return _pending(spark, sf).select("row_ord", "url", "notes", "category_override")


@query("m7_url_type")
def m7_url_type(spark, sf):
    return RQ.url_types(_pending(spark, sf), X.domain_rules(spark, sf))


@query("m8_validate_override")
def m8_validate_override(spark, sf):
    v = _pending(spark, sf).select("row_ord", S.validate_override("category_override").alias("v"))
    return v.select("row_ord", F.col("v.key").alias("override_key"), F.col("v.err").alias("override_error"))


@query("m9_request_outcome")
def m9_request_outcome(spark, sf):
    return _outcomes(spark, sf).select("row_ord", "url", "url_type", "override_key", "status", "skip_reason")


@query("x13_skip_notice")
def x13_skip_notice(spark, sf):
    return RQ.skip_notices(_outcomes(spark, sf))


@query("x9_extract_main_text")
def x9_extract_main_text(spark, sf):
    return RQ.extract_main_text(X.table(spark, sf, "pages"))


@query("x10_extract_embed_text")
def x10_extract_embed_text(spark, sf):
    return RQ.embed_text(X.embeds(spark, sf))


@query("x6_link_prompt")
def x6_link_prompt(spark, sf):
    out = _outcomes(spark, sf).where(F.col("status") == "Processed")
    pages = X.table(spark, sf, "pages").join(out.select("url").distinct(), "url", "left_semi")
    ex = RQ.extract_main_text(pages).select("url", "body")
    req = (out.join(ex, "url", "left")
           .select("row_ord", "url", F.coalesce("page_title", F.lit("")).alias("title"),
                   F.coalesce("body", F.lit("")).alias("body"), "notes", "override_key",
                   (F.col("url_type") == "twitter").alias("is_post")))
    return DR.link_prompts(req).select("row_ord", "url", "prompt")


# ---------------------------------------------------------------------------
# digest: F11 O2 X11
# ---------------------------------------------------------------------------

def _digest_top(spark, sf):
    return DG.top_per_section(DG.posts_by_section(X.cms_posts(spark, sf), X.as_of()))


@query("f11_published_today")
def f11_published_today(spark, sf):
    return DG.posts_by_section(X.cms_posts(spark, sf), X.as_of()).select("section", "id")


@query("o2_digest_top")
def o2_digest_top(spark, sf):
    return _digest_top(spark, sf).select("section", "id", F.col("rank").cast("bigint").alias("rank"))


@query("x11_digest_text")
def x11_digest_text(spark, sf):
    return DG.digest_text(_digest_top(spark, sf), X.as_of())


# ---------------------------------------------------------------------------
# videos: S14 F12 O5 J1 W5 P11 P14
# ---------------------------------------------------------------------------

def _videos(spark, sf):
    return VD.flat_videos(X.videos(spark, sf))


@query("s14_video_feed_read")
def s14_video_feed_read(spark, sf):
    """Landed listing answers (one is cut off), scanned by schema."""
    from tidewire.sources import io as IO
    root = IO.scratch_dir(spark, "video-listings")
    X.land_videos(spark, sf, root)
    return VD.flat_videos(IO.read_video_feed(spark, root).withColumn("channel", F.col("channel").cast("bigint")))


@query("f12_video_window")
def f12_video_window(spark, sf):
    return VD.in_window(_videos(spark, sf), X.as_of()).select("video_id")


@query("o5_recent_videos")
def o5_recent_videos(spark, sf):
    return VD.newest(VD.in_window(_videos(spark, sf), X.as_of())).select("video_id", "published_at")


@query("j1_unsynced_videos")
def j1_unsynced_videos(spark, sf):
    recent = VD.newest(VD.in_window(_videos(spark, sf), X.as_of()))
    return VD.unsynced(recent, X.store(spark, sf)).select("video_id", "watch_url")


@query("w5_latest_video")
def w5_latest_video(spark, sf):
    return VD.latest_per_channel(VD.in_window(_videos(spark, sf), X.as_of()))


@query("p14_video_post")
def p14_video_post(spark, sf):
    v = _videos(spark, sf)
    return VD.post_content(v).join(v.select("video_id", T.first_paragraph("description").alias("first_paragraph")),
                                   "video_id")


# ---------------------------------------------------------------------------
# sources / sinks: S3 S4 S6 S13 S15
# ---------------------------------------------------------------------------

@query("s4_latest_snapshot")
def s4_latest_snapshot(spark, sf):
    from tidewire.sources import io as IO
    root = IO.scratch_dir(spark, "snapshots")
    snap = ingested(spark, sf).select(*[c.split()[0] for c in IO.SNAPSHOT_SCHEMA.split(", ")])
    IO.write_snapshot(snap.where(F.col("id") % 2 == 0), root, "2024-01-30")
    IO.write_snapshot(snap, root, "2024-01-31")
    latest = IO.latest_snapshot(spark, root)
    return latest.select("id", "url", "category", _ts("published_at").alias("published_at"))


@query("s6_keyed_update")
def s6_keyed_update(spark, sf):
    from tidewire.sources.io import keyed_update
    base = _window(spark, sf).select("id").withColumn("priority_score", F.lit(0.0))
    return keyed_update(base, scored(spark, sf).select("id", "priority_score"), "id", ["priority_score"])


@query("s15_post_feed_read")
def s15_post_feed_read(spark, sf):
    """Landed listing answers (one is cut off), scanned by schema."""
    from tidewire.sources import io as IO
    root = IO.scratch_dir(spark, "post-listings")
    X.land_posts(spark, sf, root)
    p = IO.read_post_feed(spark, root)
    return p.select("id", F.col("title.rendered").alias("title"), F.col("excerpt.rendered").alias("excerpt"),
                    "link")


@query("a10_stage_counts")
def a10_stage_counts(spark, sf):
    p = DR.parse_answers(X.model_responses(spark, sf))
    return p.agg(F.count_if("ok").alias("drafted"), F.count(F.lit(1)).alias("requested"))


# ---------------------------------------------------------------------------
# streaming: T1 T2 T4 T5
# ---------------------------------------------------------------------------

@query("t1_stream_ingest")
def t1_stream_ingest(spark, sf):
    from tidewire.streaming import ingest_stream as ST
    out, chk = ST.stream_dirs(spark, "t1")
    store = ST.stream_ingest(X.articles_of(X.documents_stream(spark, sf)), X.as_of(), out, chk)
    return ST.stored_articles(store).select("id", "url", "source", "category")


@query("t2_stream_dedup")
def t2_stream_dedup(spark, sf):
    from tidewire.streaming import ingest_stream as ST
    out, chk = ST.stream_dirs(spark, "t2")
    ST.stream_dedup(X.articles_of(X.documents_stream(spark, sf)), "fetched_at", "url_hash", "48 hours", out, chk)
    return spark.read.parquet(out).select("url_hash")


@query("t5_stream_counts")
def t5_stream_counts(spark, sf):
    from tidewire.streaming import ingest_stream as ST
    out, chk = ST.stream_dirs(spark, "t5")
    ST.stream_counts(X.articles_of(X.documents_stream(spark, sf)), "fetched_at", out, chk)
    return ST.current_counts(spark, out).select(_ts("window_start").alias("window_start"), "source", "n_items")


@query("s1_feed_scan")
def s1_feed_scan(spark, sf):
    """Feed items landed as XML files (one folder per source), scanned back
    with an explicit schema; the source comes from the folder name."""
    from tidewire.sources import io as IO
    root = IO.scratch_dir(spark, "feeds")
    items = X.feed_items(spark, sf).select(
        "source", "link", "title", "summary", "published", F.lit(None).cast("string").alias("updated"),
        "source_ord", "item_ord")
    IO.write_feed_xml(items, root)
    got = IO.read_feed_xml(spark, root)
    return got.select(F.col("item_ord").alias("id"), "source", "link", "title", "published")


def _scanned_feeds(spark, sf):
    from tidewire.session import materialize
    from tidewire.sources import io as IO
    root = IO.scratch_dir(spark, "landed-feeds")
    X.land_feeds(spark, sf, root)
    return materialize(IO.scan_feeds(spark, root), "feeds")


@query("s1_to_s2")
def s1_to_s2(spark, sf):
    """Landed RSS and Atom files to the article snapshot: S1 P2 D1 W1 F1 F2 F3 A1."""
    from tidewire.sources import io as IO
    entries = IO.feed_entries(_scanned_feeds(spark, sf)).withColumn("source_ord", X.source_order("source"))
    snap = I.ingest(I.feed_articles(entries), X.as_of(), order=("source_ord", "feed", "item_ord"))
    return snap.select("url", "url_hash", "source", "title", _ts("published_at").alias("published_at"), "category")


@query("s1_quarantine")
def s1_quarantine(spark, sf):
    """Feed files that could not be read, while the others were."""
    from tidewire.sources import io as IO
    return IO.feed_quarantine(_scanned_feeds(spark, sf)).select("source", F.col("feed").cast("bigint").alias("feed"), "error")


@query("s3_article_snapshot_read")
def s3_article_snapshot_read(spark, sf):
    """S2 as JSON lines under ingest_date=..., read back with the schema."""
    from tidewire.sources import io as IO
    root = IO.scratch_dir(spark, "json-snapshots")
    snap = ingested(spark, sf).select(*[c.split()[0] for c in IO.SNAPSHOT_SCHEMA.split(", ")])
    IO.write_snapshot(snap, root, "2024-01-31", fmt="json")
    back = IO.read_snapshot(spark, root, fmt="json")
    return back.select("id", "url", "category", _ts("published_at").alias("published_at"),
                       _ts("fetched_at").alias("fetched_at"))


@query("s9_review_queue_write")
def s9_review_queue_write(spark, sf):
    """S9 rows written as the 12-column sheet (CSV) and read back (S10 read)."""
    from tidewire.sources import io as IO
    root = IO.scratch_dir(spark, "review-sheet")
    rows = RV.review_rows(X.drafts(spark, sf), X.articles(spark, sf), X.review_sheet(spark, sf))
    rows.select(*[F.col(c).cast("string") for c in rows.columns]).write.mode("overwrite") \
        .option("header", False).option("quoteAll", True).csv(root)
    back = IO.read_sheet_csv(spark, root)
    return back.select(F.col("draft_id").cast("bigint").alias("draft_id"), "headline", "word_count",
                       "sources", "source_urls", "body", "wp_post_id")


@query("x5_prompt_blocks")
def x5_prompt_blocks(spark, sf):
    top, members = _top_with_text(spark, sf)
    return DR.story_prompt_blocks(top, members)


@query("g3_incremental_groups")
def g3_incremental_groups(spark, sf):
    """Rows grouped by an earlier run (every fifth id) are left alone; only
    the ungrouped rows of the window are compared and grouped."""
    snap = ingested_narrow(spark, sf)
    prior = F.col("id") % 5 == 0
    store = (snap.withColumn("story_group_id", F.when(prior, F.col("id")))
             .withColumn("is_duplicate", F.when(prior, F.lit(0))))
    return G.story_groups(store, X.as_of()).select("id", "story_group_id", "is_duplicate")


@query("g3_attach")
def g3_attach(spark, sf):
    """Every fifth id is grouped by an earlier run; the others arrive, join or
    merge those groups, and the store is updated by key."""
    from tidewire.session import materialize
    from tidewire.sources.io import keyed_update
    snap = ingested_narrow(spark, sf)
    cols = ["story_group_id", "is_duplicate"]
    prior = G.story_groups(snap.where(F.col("id") % 5 == 0), X.as_of()).select("id", *cols)
    store = materialize(snap.join(prior, "id", "left"), "store")
    updates = G.story_groups(store, X.as_of(), mode="attach").select("id", *cols)
    after = keyed_update(store, updates, "id", cols)
    return after.where(F.col("story_group_id").isNotNull()).select("id", *cols)


# ---------------------------------------------------------------------------
# one key per remaining inventory ID (projections of the operators above)
# ---------------------------------------------------------------------------

def _scored_cols(spark, sf, *cols):
    return scored(spark, sf).select("id", *cols)


@query("m1_recency_score")
def m1_recency_score(spark, sf):
    return _scored_cols(spark, sf, "recency")


@query("m2_authority_score")
def m2_authority_score(spark, sf):
    return _scored_cols(spark, sf, "source", "authority")


@query("m3_cross_source_bonus")
def m3_cross_source_bonus(spark, sf):
    return _scored_cols(spark, sf, "group_size", "bonus")


@query("m4_category_boost")
def m4_category_boost(spark, sf):
    return _scored_cols(spark, sf, "category", "boost")


@query("m6_multi_source_flag")
def m6_multi_source_flag(spark, sf):
    return _scored_cols(spark, sf, "is_multi_source")


@query("m10_draft_category")
def m10_draft_category(spark, sf):
    p = _pending(spark, sf)
    model_cat = X._pick(X.FIXTURE_CATEGORIES, F.col("row_ord") % 8)
    v = p.select("row_ord", S.validate_override("category_override").alias("v"), model_cat.alias("model"))
    return v.select("row_ord", S.draft_category("v.key", "model").alias("category"))


@query("p4_jaccard")
def p4_jaccard(spark, sf):
    pairs = j3_similar_pairs(spark, sf)
    return pairs.select("id_a", "id_b", F.round(F.col("n_inter") / (F.col("n_a") + F.col("n_b") - F.col("n_inter")),
                                                6).alias("jaccard"))


@query("p11_first_paragraph")
def p11_first_paragraph(spark, sf):
    return _videos(spark, sf).select("video_id", T.first_paragraph("description").alias("first_paragraph"))


@query("d6_day_start")
def d6_day_start(spark, sf):
    return X.cms_posts(spark, sf).select("id", _ts(D.day_start("date")).alias("day_start"))


@query("o3_queue_order")
def o3_queue_order(spark, sf):
    """Review queue newest first (a range-partitioned global sort)."""
    d = X.drafts(spark, sf).where(F.col("status") == "pending_editor")
    return d.orderBy(F.col("id").desc()).select("id", "headline")


@query("x2_dedupe_ids")
def x2_dedupe_ids(spark, sf):
    return x5_story_prompt(spark, sf).select("story_id", "raw_article_ids")


@query("a4_distinct_concat")
def a4_distinct_concat(spark, sf):
    return j8_review_rows(spark, sf).select("draft_id", "sources")


@query("a5_group_concat")
def a5_group_concat(spark, sf):
    return j7_preview(spark, sf).select("id", "sources", "source_urls")


@query("a11_max_downloads")
def a11_max_downloads(spark, sf):
    return j10_best_media(spark, sf).where(F.col("origin") == "photo").select("id", "photo_id")


@query("s7_draft_append")
def s7_draft_append(spark, sf):
    rows = DR.new_draft_rows(DR.parse_answers(X.model_responses(spark, sf)), X.as_of())
    return rows.select("id", "headline", "category", "status", _ts("created_at").alias("created_at"),
                       F.array_join("image_keywords", ",").alias("image_keywords"))


@query("s13_html_pages_read")
def s13_html_pages_read(spark, sf):
    return X.table(spark, sf, "pages").select("url", F.length("html").cast("bigint").alias("n_chars"))


@query("t3_stream_upsert_replay")
def t3_stream_upsert_replay(spark, sf):
    """The same landed files streamed twice (a fresh checkpoint = a full
    replay) into one store: the second run inserts nothing."""
    from tidewire.streaming import ingest_stream as ST
    out, chk = ST.stream_dirs(spark, "t3")
    ST.stream_ingest(X.articles_of(X.documents_stream(spark, sf)), X.as_of(), out, chk)
    store = ST.stream_ingest(X.articles_of(X.documents_stream(spark, sf)), X.as_of(), out, chk + "-replay")
    return ST.stored_articles(store).select("id", "url", "category")


@query("t4_late_drop")
def t4_late_drop(spark, sf):
    """The 24 h staleness rule as an explicit predicate inside the stream
    (same rows in batch and stream); the watermark only bounds state."""
    from tidewire.streaming import ingest_stream as ST
    out, chk = ST.stream_dirs(spark, "t4")
    s = I.fresh(X.articles_of(X.documents_stream(spark, sf)), X.as_of()).select("id", "published_at")
    (s.writeStream.format("parquet").option("path", out).option("checkpointLocation", chk)
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(out).select("id", _ts("published_at").alias("published_at"))


@query("j4_group_size_lookup")
def j4_group_size_lookup(spark, sf):
    return _scored_cols(spark, sf, "story_group_id", "group_size")


@query("j5_authority_lookup")
def j5_authority_lookup(spark, sf):
    return scored(spark, sf).select("source", "authority").distinct()


@query("j9_category_lookup")
def j9_category_lookup(spark, sf):
    d = RT.route_categories(RT.unpublished(X.drafts(spark, sf)), X.cms_categories(spark, sf), keep_lookup=True)
    return d.select("id", "category", "mapped_name", F.col("topic_id").cast("string").alias("topic_id"))


@query("j11_section_overlap")
def j11_section_overlap(spark, sf):
    ids = sorted({i for _, ids in C.DIGEST_SECTIONS for i in ids})
    p = X.cms_posts(spark, sf)
    return p.where(F.arrays_overlap(F.col("categories").cast("array<bigint>"),
                                    F.array(*[F.lit(i) for i in ids]).cast("array<bigint>"))).select("id")


@query("j13_domain_rule_lookup")
def j13_domain_rule_lookup(spark, sf):
    t = RQ.url_types(_pending(spark, sf), X.domain_rules(spark, sf))
    return t.where(F.col("url_type") != "article").select("row_ord", "url_type", "label")


@query("w4_best_media")
def w4_best_media(spark, sf):
    return j10_best_media(spark, sf).where(F.col("origin") == "library").select("id", "media_id")


@query("o4_longest_first")
def o4_longest_first(spark, sf):
    return x5_prompt_blocks(spark, sf).select("story_id", "member_id", "content_len")


@query("x4_repair_json_newlines")
def x4_repair_json_newlines(spark, sf):
    return DR.needs_newline_repair(X.model_responses(spark, sf))


@query("s11_link_sheet_read")
def s11_link_sheet_read(spark, sf):
    """The link-request sheet landed as CSV (row number first), read back
    positionally; the pending filter applies to the read rows."""
    from tidewire.sources import io as IO
    root = IO.scratch_dir(spark, "link-sheet")
    r = X.link_requests(spark, sf)
    r.select(F.col("row_ord").cast("string"), "url", "notes", "status", F.lit("").alias("wp_post_id"),
             F.lit("").alias("date_added"), "category_override") \
        .write.mode("overwrite").option("quoteAll", True).csv(root)
    back = IO.read_sheet_csv(spark, root, "row_ord string, " + IO.LINK_SHEET_SCHEMA)
    back = back.withColumn("row_ord", F.col("row_ord").cast("bigint"))
    return RQ.pending_requests(back).select("row_ord", "url", "notes", "category_override")
