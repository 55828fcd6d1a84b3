"""Videos: S14 flat listing, F12 window, O5 newest, J1 unsynced, W5 latest
per channel, P11/P14 post content, sync rows for the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire import config as C
from tidewire.functions import text as T


def flat_videos(items: DataFrame, embed: str = C.VIDEO_EMBED, watch: str = C.VIDEO_WATCH) -> DataFrame:
    """Nested items -> flat rows; items without an id are dropped;
    missing fields become ''."""
    vid = F.col("id.videoId")
    return items.where(vid.isNotNull()).select(
        vid.alias("video_id"),
        *([F.col("channel")] if "channel" in items.columns else []),
        F.coalesce(F.col("snippet.title"), F.lit("")).alias("title"),
        F.coalesce(F.col("snippet.description"), F.lit("")).alias("description"),
        F.coalesce(F.col("snippet.publishedAt"), F.lit("")).alias("published_at"),
        F.coalesce(F.col("snippet.thumbnails.high.url"), F.lit("")).alias("thumbnail"),
        F.concat(F.lit(embed), vid).alias("embed_url"),
        F.concat(F.lit(watch), vid).alias("watch_url"))


def published_ts(col: str = "published_at") -> Column:
    return F.try_to_timestamp(F.col(col), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))


def in_window(videos: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """published strictly after ``as_of - hours``."""
    cutoff = F.timestamp_seconds(F.unix_seconds(as_of) - hours * 3600)
    return videos.where(published_ts() > cutoff)


def newest(videos: DataFrame, n: int = 10) -> DataFrame:
    """Newest n (video id on ties)."""
    return videos.orderBy(published_ts().desc(), F.col("video_id").asc()).limit(n)


def unsynced(videos: DataFrame, store: DataFrame) -> DataFrame:
    """Videos whose watch URL is not in the store."""
    return videos.join(store.select(F.col("url").alias("watch_url")).where(F.col("watch_url").isNotNull()),
                       "watch_url", "left_anti")


def latest_per_channel(videos: DataFrame) -> DataFrame:
    """W5 (newest per channel, by intent): max of (published, video id) per
    channel — a map-side combined aggregate, not a window."""
    best = videos.groupBy("channel").agg(
        F.max(F.struct(published_ts().alias("p"), F.col("video_id").alias("v"))).alias("_b"))
    return best.select("channel", F.col("_b.v").alias("video_id"))


def post_content(videos: DataFrame) -> DataFrame:
    """P11 + P14: first description paragraph (if any) + embed block + link."""
    first = T.first_paragraph("description")
    desc_html = F.when(first != "", F.concat(F.lit("<p>"), first, F.lit("</p>\n\n"))).otherwise(F.lit(""))
    block = F.concat(
        F.lit('<figure class="video-embed"><iframe src="'), F.col("embed_url"), F.lit('" title="'),
        F.col("title"), F.lit('" allowfullscreen></iframe></figure>\n\n<p><a href="'), F.col("watch_url"),
        F.lit('" target="_blank" rel="noopener">Watch the video</a></p>'))
    return videos.select("video_id", F.concat(desc_html, block).alias("content"))


def sync_rows(videos: DataFrame, fetched_at: Column) -> DataFrame:
    """S5 rows for synced videos (url = watch URL, url_hash = video id)."""
    return videos.select(
        F.col("watch_url").alias("url"), F.col("video_id").alias("url_hash"), F.lit("video").alias("source"),
        "title", T.substr_cap("description", 500).alias("summary"), "published_at",
        fetched_at.alias("fetched_at"), F.lit("Video").alias("category"))
