"""Readers and sinks: S1 feeds (RSS, RDF, Atom), S2/S3/S4 snapshots, F4 look-back
range, S6 keyed update, S8 schema evolution, S10/S11 sheet CSV reads, S13 pages,
S15 posts.

Paths are shared storage (the checkpoint folder family on a cluster); no
machine-local folders are used."""

from __future__ import annotations

import os
import uuid
from datetime import datetime, timedelta
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.session import ensure_checkpoint_dir

SNAPSHOT_SCHEMA = ("id bigint, url string, url_hash string, source string, title string, summary string, "
                   "published_at timestamp, fetched_at timestamp, category string, raw_content string")
FEED_ITEM_SCHEMA = ("link string, title string, summary string, published string, updated string, "
                    "source_ord int, item_ord bigint")
SHEET_SCHEMA = ("draft_id string, date_generated string, category string, headline string, "
                "seo_description string, body string, word_count string, sources string, "
                "source_urls string, approval string, editor_notes string, wp_post_id string")
LINK_SHEET_SCHEMA = "url string, notes string, status string, wp_post_id string, date_added string, category_override string"


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the checkpoints (shared storage on a cluster)."""
    root = ensure_checkpoint_dir(spark)
    return os.path.join(root, f"tidewire-{name}-{uuid.uuid4().hex[:12]}")


def write_snapshot(df: DataFrame, root: str, ingest_date: str, fmt: str = "parquet") -> None:
    """today's rows under ``ingest_date=D``; re-running a day replaces
    only that day's partition (dynamic partition overwrite)."""
    (df.withColumn("ingest_date", F.lit(ingest_date))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("ingest_date").format(fmt).save(root))


def read_snapshot(spark: SparkSession, root: str, schema: str = SNAPSHOT_SCHEMA,
                  fmt: str = "parquet") -> DataFrame:
    """S3: read snapshots with an explicit schema (no inference)."""
    return spark.read.schema(schema + ", ingest_date string").format(fmt).load(root)


def write_snapshot_days(df: DataFrame, root: str, ts_col: str = "fetched_at", fmt: str = "parquet") -> None:
    """S2 for rows of several days: each row under the day of ``ts_col``."""
    (df.withColumn("ingest_date", F.date_format(ts_col, "yyyy-MM-dd"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("ingest_date").format(fmt).save(root))


def partition_values(spark: SparkSession, root: str, column: str = "ingest_date") -> list[str]:
    """The values of a partition column by its folders' names, in order: one
    listing of the root, no file is opened."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    names = [f.getPath().getName() for f in files.listStatus(path) if f.isDirectory()]
    return sorted(unquote(n.split("=", 1)[1]) for n in names if n.startswith(f"{column}="))


def read_days(spark: SparkSession, root: str, days: list[str], schema: str = SNAPSHOT_SCHEMA,
              fmt: str = "parquet") -> DataFrame:
    """The snapshots of these days: only their folders are listed and read."""
    reader = spark.read.schema(schema + ", ingest_date string").option("basePath", root).format(fmt)
    return reader.load([f"{root}/ingest_date={d}" for d in days]).where(F.col("ingest_date").isin(days))


def latest_snapshot(spark: SparkSession, root: str, schema: str = SNAPSHOT_SCHEMA,
                    fmt: str = "parquet") -> DataFrame:
    """The lexicographically greatest ``ingest_date`` partition, found by
    the folders' names; the others are neither listed nor opened."""
    days = partition_values(spark, root)
    if not days:
        raise FileNotFoundError(f"no snapshot under {root}")
    return read_days(spark, root, days[-1:], schema, fmt)


def read_window(spark: SparkSession, root: str, as_of: str, hours: int, schema: str = SNAPSHOT_SCHEMA,
                fmt: str = "parquet") -> DataFrame:
    """F4 on stored snapshots: rows fetched within ``hours`` before ``as_of``
    (``yyyy-MM-dd HH:mm:ss``, UTC) or later.  A row lies under the day it was
    fetched on, so days before the cutoff's are not listed."""
    cutoff = datetime.strptime(as_of, "%Y-%m-%d %H:%M:%S") - timedelta(hours=hours)
    days = [d for d in partition_values(spark, root) if d >= cutoff.strftime("%Y-%m-%d")]
    if not days:
        return spark.createDataFrame([], schema + ", ingest_date string")
    return read_days(spark, root, days, schema, fmt).where(F.col("fetched_at") >= F.to_timestamp(F.lit(str(cutoff))))


def write_feed_xml(items: DataFrame, root: str, row_tag: str = "item") -> None:
    """Land feed items as RSS-like XML, one folder per source."""
    (items.write.mode("overwrite").partitionBy("source").option("rowTag", row_tag)
     .option("rootTag", "channel").xml(root))


def read_feed_xml(spark: SparkSession, path: str, row_tag: str = "item",
                  schema: str = FEED_ITEM_SCHEMA) -> DataFrame:
    """Landed feed files as rows (explicit schema — inference would type
    a title like "T1" as a timestamp; malformed records are kept PERMISSIVE;
    text is taken verbatim; ``source=...`` folders give the source column)."""
    return (spark.read.schema(schema + ", source string").option("rowTag", row_tag)
            .option("mode", "PERMISSIVE").option("ignoreSurroundingSpaces", "false")
            .xml(path).withColumn("file_name", F.col("_metadata.file_name")))


# Element names of RSS 2.0, RDF (RSS 1.0) and Atom (fixed values).
_ITEM = ("struct<title: string, link: string, description: string, `content:encoded`: string, pubDate: string, "
         "`dc:date`: string, guid: struct<_isPermaLink: string, _VALUE: string>>")
_ENTRY = ("struct<title: string, link: array<struct<_href: string, _rel: string>>, summary: string, content: string, "
          "published: string, updated: string, issued: string>")
_FEED = (f"channel struct<title: string, item: array<{_ITEM}>>, item array<{_ITEM}>, entry array<{_ENTRY}>, "
         "_broken string")


def _empty_as_null(c) -> Column:
    return F.when(F.trim(c) != "", c)


def _of_item(x: Column) -> Column:
    """An RSS item as link, title, summary, published, updated."""
    permanent = F.when(F.coalesce(x["guid"]["_isPermaLink"], F.lit("true")) != "false", x["guid"]["_VALUE"])
    return F.struct(
        F.trim(F.coalesce(_empty_as_null(x["link"]), _empty_as_null(permanent))).alias("link"), x["title"].alias("title"),
        F.coalesce(x["description"], x["content:encoded"]).alias("summary"),
        F.coalesce(x["pubDate"], x["dc:date"]).alias("published"), F.lit(None).cast("string").alias("updated"))


def _of_entry(x: Column) -> Column:
    """An Atom entry likewise; its link is the alternate one."""
    own = F.filter(x["link"], lambda k: F.coalesce(k["_rel"], F.lit("alternate")) == "alternate")
    return F.struct(
        F.trim(F.get(own, F.lit(0))["_href"]).alias("link"),
        x["title"].alias("title"), F.coalesce(x["summary"], x["content"]).alias("summary"),
        F.coalesce(x["published"], x["issued"]).alias("published"), x["updated"].alias("updated"))


def scan_feeds(spark: SparkSession, path: str) -> DataFrame:
    """Landed feed files, RSS, RDF and Atom alike, in one scan: a row for
    each item (``item_ord``: its place in its file), or one for a file that is
    broken or no feed, with ``error`` (none for an empty file).  Partition folders (``source=...``) give
    further columns.  A feed file is one row while it is parsed; write the
    result once, then take ``feed_entries`` and ``feed_quarantine`` of it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
    kept = [c for c in files.columns if c not in ("modificationTime", "content")]
    head = F.substring(F.col("content"), 1, 200).cast("string")
    latin = F.regexp_like(F.lower(head), F.lit("encoding=[\"'](iso-8859-1|latin1|latin-1|windows-1252)[\"']"))
    text = F.when(latin, F.decode("content", "ISO-8859-1")).otherwise(F.make_valid_utf8(F.col("content").cast("string")))
    text = F.ltrim(F.ltrim(text, F.lit("\ufeff")))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken", "ignoreSurroundingSpaces": "false"}
    # the parser takes a text that breaks off as if it ended there: it has to end
    # with its root's end, and at most white space and comments in its last 4096 characters
    root = F.regexp_extract(text, "<([A-Za-z_][\\w.:-]*)", 1)
    tail = F.regexp_replace(F.right(text, F.lit(4096)), "(\\s|<!--(?s:.*?)-->)+$", "")
    whole = F.endswith(tail, F.concat(F.lit("</"), root, F.lit(">")))
    parsed = files.select(*kept, F.when(whole, F.from_xml(text, _FEED, options)).alias("_feed"))
    items = F.coalesce(F.transform("_feed.channel.item", _of_item), F.transform("_feed.item", _of_item),
                       F.transform("_feed.entry", _of_entry))
    error = (F.when(F.col("_feed").isNull() | F.col("_feed._broken").isNotNull(), F.lit("malformed XML"))
             .when(F.col("_feed.channel").isNull() & items.isNull(), F.lit("no feed")))
    rows = parsed.select(*kept, error.alias("error"), F.when(error.isNull(), items).alias("_items"))
    return (rows.select(*kept, "error", F.posexplode_outer("_items").alias("item_ord", "_x"))
            .select(*kept, "error", F.col("item_ord").cast("bigint").alias("item_ord"), "_x.*"))


def feed_entries(scanned: DataFrame) -> DataFrame:
    """The items of ``scan_feeds``."""
    return scanned.where(F.col("item_ord").isNotNull()).drop("error", "length")


def feed_quarantine(scanned: DataFrame) -> DataFrame:
    """The files of ``scan_feeds`` that gave no items for an error."""
    return scanned.where(F.col("error").isNotNull()).drop("item_ord", "link", "title", "summary", "published", "updated")


VIDEO_FEED_SCHEMA = ("items array<struct<id: struct<videoId: string>, snippet: struct<channelId: string, title: string, "
                     "description: string, publishedAt: string, thumbnails: struct<high: struct<url: string>>>>>")
POST_FEED_SCHEMA = ("id bigint, title struct<rendered: string>, excerpt struct<rendered: string>, link string, "
                    "categories array<bigint>, status string, date string")


def scan_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Landed JSON answers, one (multi-line) object or list of objects a
    file, by an explicit schema: missing keys are NULL, further keys are passed
    over.  A file that is no JSON of that form is one row with its text in
    ``_broken``.  ``file``: where a row comes from."""
    return (spark.read.schema(f"{schema}, _broken string").option("multiLine", True).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_broken").json(path).withColumn("file", F.col("_metadata.file_path")))


def json_quarantine(scanned: DataFrame) -> DataFrame:
    return scanned.where(F.col("_broken").isNotNull()).select("file", F.length("_broken").alias("chars"))


def read_video_feed(spark: SparkSession, path: str) -> DataFrame:
    """The items of video listings, with ``channel`` beside them."""
    good = scan_json(spark, path, VIDEO_FEED_SCHEMA).where(F.col("_broken").isNull())
    return good.select(F.explode("items").alias("x")).select("x.*", F.col("x.snippet.channelId").alias("channel"))


def read_post_feed(spark: SparkSession, path: str) -> DataFrame:
    """The posts of CMS listings."""
    good = scan_json(spark, path, POST_FEED_SCHEMA).where(F.col("_broken").isNull())
    return good.drop("_broken", "file")


def read_sheet_csv(spark: SparkSession, path: str, schema: str = SHEET_SCHEMA) -> DataFrame:
    """Positional sheet rows; short rows and empty cells read as ''
    (a sheet has no NULL: missing cells are padded with empty text)."""
    df = (spark.read.schema(schema).option("multiLine", True).option("header", False)
          .option("mode", "PERMISSIVE").csv(path))
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in df.columns])


def keyed_update(base: DataFrame, updates: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """``UPDATE base SET cols WHERE key = ?`` as a left join + coalesce
    (a new snapshot is written by the caller)."""
    u = updates.select(key, *[F.col(c).alias(f"_u_{c}") for c in cols])
    j = base.join(u, key, "left")
    for c in cols:
        j = j.withColumn(c, F.coalesce(F.col(f"_u_{c}"), F.col(c))).drop(f"_u_{c}")
    return j


def evolve_union(old: DataFrame, new: DataFrame) -> DataFrame:
    """Append rows whose table gained columns (missing ones are NULL)."""
    return old.unionByName(new, allowMissingColumns=True)
