"""Derived input tables over the given parquet tables.

The pipeline's real inputs (landed feed items, a store of articles, draft rows,
review sheets, link-request sheets, model answers, CMS posts, media catalogues,
video listings) are derived here from ``/root/testdata`` by fixed rules, so
that every registered query reads the given tables and grows with them.  The
DuckDB oracle derives the very same rows with SQL (``tidewire.plans.oracle``).

Rules are keyed on ids only (``mod`` arithmetic), never on row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire import config as C
from tidewire.functions import text as T
from tidewire.session import AS_OF

FIXTURE_CATEGORIES = ["Politics", "Business", "Sports", "Technology",
                      "Culture", "Local", "Regional", "World"]

# Section names given to the first ten nations (CMS category fixture).
SECTION_NAMES = ["Breaking News", "Politics", "Business", "Sports", "Tech and Science",
                 "Culture", "Regional News", "World", "Opinion", "Letters"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of() -> Column:
    return F.to_timestamp(F.lit(AS_OF))


def minutes_before(minutes: Column) -> Column:
    return F.timestamp_seconds(F.unix_seconds(as_of()) - minutes.cast("bigint") * 60)


def _pick(values: list[str], idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def _json_str(x: Column) -> Column:
    """Minimal JSON string escaping used to build model answers."""
    x = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    x = F.replace(x, F.lit('"'), F.lit('\\"'))
    x = F.replace(x, F.lit("\t"), F.lit("\\t"))
    x = F.replace(x, F.lit("\r"), F.lit("\\r"))
    return F.concat(F.lit('"'), F.replace(x, F.lit("\n"), F.lit("\\n")), F.lit('"'))


# ---------------------------------------------------------------------------
# articles / feed items / store
# ---------------------------------------------------------------------------

def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed-level article rows: every tenth document repeats its neighbour's URL."""
    return articles_of(table(spark, sf_dir, "documents"))


def documents_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents file as a streaming file source (explicit schema)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    # a file or a folder of files: a stream's plain path has to be a folder, a pattern may be either
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/documents.parque[t]")


def articles_of(d: DataFrame) -> DataFrame:
    """Article rows from a documents DataFrame (batch or streaming)."""
    doc = F.col("doc_id")
    url_n = F.when(doc % 10 == 9, doc - 1).otherwise(doc)
    url = F.concat(F.lit("https://news.example.com/"), url_n.cast("string"))
    return d.select(
        doc.alias("id"),
        F.col("source"),
        F.substring(F.col("source"), 4, 10).cast("int").alias("source_ord"),
        doc.alias("item_ord"),
        url.alias("url"),
        T.url_hash(url).alias("url_hash"),
        F.substring_index(F.col("text"), "\n", 1).alias("title"),
        F.col("text").alias("summary"),
        F.when(doc % 17 == 0, F.lit(None).cast("timestamp"))
         .otherwise(minutes_before((doc * 37) % 2160)).alias("published_at"),
        minutes_before((doc % 30) * 60).alias("fetched_at"),
        F.col("text").alias("raw_content"),
    )


def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed feed entries: link sometimes missing, dates as text in four forms."""
    a = articles(spark, sf_dir)
    i = F.col("id")
    rfc = F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss")
    published = (F.when(F.col("published_at").isNull(), F.lit(None).cast("string"))
                 .when(i % 4 == 0, F.concat(rfc, F.lit(" +0000")))
                 .when(i % 4 == 1, F.concat(rfc, F.lit(" GMT")))
                 .when(i % 4 == 2, F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
                 .otherwise(F.concat(F.lit("sometime "), i.cast("string"))))
    link = (F.when(i % 41 == 0, F.lit("")).when(i % 43 == 0, F.lit(None).cast("string"))
            .otherwise(F.col("url")))
    return a.select("id", "source", "source_ord", "item_ord", link.alias("link"),
                    F.concat(F.lit("  "), F.col("title"), F.lit(" ")).alias("title"),
                    F.col("summary"), published.alias("published"))


def source_order(source: str) -> Column:
    return F.substring(F.col(source), 4, 10).cast("int")


FEED_LENGTH = 200


def _xml(x: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")):
        x = F.replace(x, F.lit(mark), F.lit(entity))
    return F.coalesce(x, F.lit(""))


def land_feeds(spark: SparkSession, sf_dir: str, root: str) -> None:
    """``feed_items`` landed as feed files, RSS for the even sources and Atom for
    the odd ones, each with the items of ``FEED_LENGTH`` ids, and one more file a
    source that was cut off in transfer."""
    items = feed_items(spark, sf_dir).withColumn("feed", F.floor(F.col("id") / FEED_LENGTH))
    link = F.when(F.col("link").isNotNull(), F.concat(F.lit("<link>"), _xml(F.col("link")), F.lit("</link>")))
    href = F.when(F.col("link").isNotNull(), F.concat(F.lit('<link rel="alternate" href="'), _xml(F.col("link")), F.lit('"/>')))
    title, summary, published = (_xml(F.col(c)) for c in ("title", "summary", "published"))
    rss = F.concat(F.lit("<item><title>"), title, F.lit("</title>"), F.coalesce(link, F.lit("")),
                   F.lit("<description>"), summary, F.lit("</description><pubDate>"), published, F.lit("</pubDate></item>"))
    atom = F.concat(F.lit('<entry><link rel="self" href="https://feeds.example.com/"/>'
                          '<title type="html">'), title, F.lit("</title>"), F.coalesce(href, F.lit("")),
                    F.lit('<summary type="html">'), summary, F.lit("</summary><published>"), published,
                    F.lit("</published></entry>"))
    is_atom = F.col("source_ord") % 2 == 1
    files = (items.select("source", "source_ord", "feed", F.struct("item_ord", F.when(is_atom, atom).otherwise(rss).alias("x")).alias("i"))
             .groupBy("source", "source_ord", "feed").agg(F.array_sort(F.collect_list("i")).alias("i")))
    body = F.array_join(F.transform("i", lambda i: i["x"]), "\n")
    head = '<?xml version="1.0" encoding="UTF-8"?>\n'
    text = F.when(is_atom, F.concat(F.lit(head + '<feed xmlns="http://www.w3.org/2005/Atom"><title>News</title>'), body,
                                    F.lit("</feed>"))).otherwise(
        F.concat(F.lit(head + '<rss version="2.0"><channel><title>News</title>'), body, F.lit("</channel></rss>")))
    whole = files.select("source", "feed", text.alias("value"))
    first = whole.groupBy("source").agg(F.min_by("value", "feed").alias("value"))
    broken = first.select("source", F.lit(-1).cast("bigint").alias("feed"),
                          F.substr(F.col("value"), F.lit(1), (F.length("value") * 2 / 3).cast("int")).alias("value"))
    whole.unionByName(broken).write.option("maxRecordsPerFile", 1).partitionBy("source", "feed").text(root)


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows already stored: every third article and the watch URL of every fourth video."""
    a = articles(spark, sf_dir).where(F.col("id") % 3 == 0).select("url", "url_hash")
    v = videos(spark, sf_dir).where(F.col("page_id") % 4 == 0).select(
        F.concat(F.lit(C.VIDEO_WATCH), F.col("id.videoId")).alias("url"),
        F.col("id.videoId").alias("url_hash"))
    return a.unionByName(v)


# ---------------------------------------------------------------------------
# drafts / review sheet
# ---------------------------------------------------------------------------

def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    doc = F.col("doc_id")
    title = F.substring_index(F.col("text"), "\n", 1)
    w1 = F.split_part(F.col("p_name"), F.lit(" "), F.lit(1))
    w2 = F.split_part(F.col("p_name"), F.lit(" "), F.lit(2))
    kw = (F.when(doc % 6 == 0, F.lit(None).cast("string"))
          .when(doc % 6 == 1, F.lit("[]"))
          .when(doc % 6 == 2, F.lit("not json"))
          .when(doc % 6 == 3, F.concat(F.lit('["'), w2, F.lit('","'), w1, F.lit('"]')))
          .when(doc % 6 == 4, F.concat(F.lit('["zzz'), doc.cast("string"), F.lit('","'), w1, F.lit('"]')))
          .otherwise(F.concat(F.lit('["qqq","'), F.lower(F.col("p_type")), F.lit('","sss","'), w2, F.lit('"]'))))
    return d.join(p, d.doc_id == p.p_partkey, "left").select(
        doc.alias("id"),
        F.when(doc % 11 == 0, F.array().cast("array<bigint>"))
         .otherwise(F.array(doc, doc + 1)).alias("raw_article_ids"),
        title.alias("headline"),
        F.concat(F.lit("<p>"), F.replace(F.col("text"), F.lit("\n"), F.lit("</p><p>")), F.lit("</p>")).alias("body"),
        _pick(FIXTURE_CATEGORIES, doc % 8).alias("category"),
        F.col("text").alias("seo_description"),
        kw.alias("image_keywords"),
        F.when(doc % 7 == 0, F.lit(0).cast("bigint")).when(doc % 2 == 0, doc + 10000)
         .otherwise(F.lit(None).cast("bigint")).alias("wp_post_id"),
        F.when(doc % 4 == 0, F.lit(None).cast("bigint")).when(doc % 4 == 1, F.lit(0).cast("bigint"))
         .otherwise(doc + 20000).alias("wp_image_id"),
        _pick(C.DRAFT_STATUSES, doc % 5).alias("status"),
        minutes_before((doc % 48) * 60).alias("created_at"),
    )


def review_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Editor decisions, one row per sheet line (row_ord = sheet order), on every
    third draft of the whole range; the others are not in the sheet yet."""
    e = table(spark, sf_dir, "events")
    ids = table(spark, sf_dir, "documents").agg(F.floor(F.max("doc_id") / 3) + 1)
    eid = F.col("event_id")
    draft_id = (F.when(eid % 97 == 0, F.concat(F.lit("x"), eid.cast("string")))
                .when(eid % 101 == 0, F.lit(""))
                .otherwise((3 * (eid % ids.scalar())).cast("string")))
    approval = (F.when(F.col("event_type") == "purchase", F.lit("approve"))
                .when(F.col("event_type") == "error", F.lit("REJECT "))
                .when(F.col("event_type") == "click", F.lit(" Edit"))
                .when(F.col("event_type") == "view", F.lit(""))
                .otherwise(F.lit("maybe")))
    return e.select(eid.alias("row_ord"), draft_id.alias("draft_id"),
                    approval.alias("approval"), F.col("props").alias("notes"))


# ---------------------------------------------------------------------------
# link requests / domain rules / pages / embeds
# ---------------------------------------------------------------------------

def link_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    pid = F.col("page_id")
    return p.select(
        (pid + 2).alias("row_ord"),
        F.col("url"),
        F.when(pid % 3 == 0, F.concat(F.lit("note "), pid.cast("string"))).otherwise(F.lit("")).alias("notes"),
        _pick(["", "Processed", "Error", "Error — timeout"], pid % 4).alias("status"),
        _pick(["", "politics", " Opinion ", "weather", "Breaking News", "SPORTS"], pid % 6)
        .alias("category_override"),
    )


def domain_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL rules built from the pages' own domains: exact social rules and
    suffix paywall rules (``m.``/``blog.`` prefixes removed)."""
    p = table(spark, sf_dir, "pages")
    dom = T.url_domain(F.col("url"))
    pid = F.col("page_id")
    base = F.regexp_replace(dom, "^(m|blog)\\.", "")
    social = p.where(pid % 11 == 1).select(dom.alias("domain"), F.lit("twitter").alias("kind"),
                                           F.lit("").alias("label"), F.lit("exact").alias("match"))
    blocked = p.where(pid % 11 == 2).select(dom.alias("domain"), F.lit("blocked_social").alias("kind"),
                                            F.lit("").alias("label"), F.lit("exact").alias("match"))
    paywall = p.where(pid % 11 == 3).select(
        base.alias("domain"), F.lit("paywall").alias("kind"),
        F.initcap(F.split_part(base, F.lit("."), F.lit(1))).alias("label"), F.lit("suffix").alias("match"))
    return social.unionByName(blocked).unionByName(paywall).distinct()


def fetch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of fetching each requested page (the fetch itself is external)."""
    p = table(spark, sf_dir, "pages")
    pid = F.col("page_id")
    status = F.when(pid % 10 == 7, F.lit(403)).when(pid % 10 == 8, F.lit(500)).otherwise(F.lit(200))
    err = F.when(pid % 10 == 8, F.concat(F.lit("HTTP 500 Server Error for url: "), F.col("url")))
    return p.select(F.col("url"), status.cast("int").alias("http_status"), err.alias("error"))


def embeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    cid = F.col("conv_id")
    html = F.when(cid % 9 == 0, F.concat(F.lit("<blockquote>"), F.col("text"), F.lit("</blockquote>"))) \
        .otherwise(F.concat(F.lit("<blockquote><p>"), F.col("text"), F.lit("</p>&mdash; User "),
                            cid.cast("string"), F.lit("</blockquote>")))
    return c.select(
        F.concat(F.lit("https://x.com/u"), cid.cast("string"), F.lit("/status/"), F.col("turn").cast("string")).alias("url"),
        html.alias("html"),
        F.when(cid % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("User "), cid.cast("string"))).alias("author_name"),
        F.concat(F.lit("https://x.example.com/u"), cid.cast("string"), F.lit("/")).alias("author_url"),
    )


# ---------------------------------------------------------------------------
# model answers
# ---------------------------------------------------------------------------

def model_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    cid = F.col("conv_id")
    text = F.col("text")
    payload = F.concat(
        F.lit('{"headline": '), _json_str(F.substring_index(text, "\n", 1)),
        F.lit(', "body": '), _json_str(F.concat(F.lit("<p>"), text, F.lit("</p>"))),
        F.lit(', "category": '), _json_str(_pick(FIXTURE_CATEGORIES, cid % 8)),
        F.lit(', "seo_description": '), _json_str(text),
        F.lit(', "image_keywords": ['), _json_str(F.concat(F.lit("kw"), cid.cast("string"))),
        F.lit(", "), _json_str(F.lit("news")), F.lit("]"),
        F.lit(', "source_attribution": '), _json_str(F.concat(F.lit("src"), (cid % 20).cast("string"))),
        F.lit("}"))
    raw = (F.when(cid % 4 == 0, payload)
           .when(cid % 4 == 1, F.concat(F.lit("```json\n"), payload, F.lit("\n```")))
           .when(cid % 4 == 2, F.concat(F.lit("Here is the draft:\n"), payload, F.lit("\nHope it helps.")))
           .otherwise(F.replace(payload, F.lit("\\n"), F.lit("\n"))))
    return c.select((cid * 100 + F.col("turn")).alias("request_id"), raw.alias("raw"))


# ---------------------------------------------------------------------------
# CMS posts / categories / media / videos
# ---------------------------------------------------------------------------

def cms_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    doc = F.col("doc_id")
    return d.select(
        doc.alias("id"),
        F.struct(F.substring_index(F.col("text"), "\n", 1).alias("rendered")).alias("title"),
        F.struct(F.concat(F.lit("<p>"), F.col("text"), F.lit("&#8230;</p>"))
                 .alias("rendered")).alias("excerpt"),
        F.concat(F.lit("https://news.example.com/p/"), doc.cast("string")).alias("link"),
        F.array(doc % 3, doc % 7).alias("categories"),
        F.when(doc % 4 == 0, F.lit("draft")).otherwise(F.lit("publish")).alias("status"),
        minutes_before(F.lit(1440) - (doc * 37) % 2880).alias("date"),
    )


def cms_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    name = F.when(k < len(SECTION_NAMES), _pick(SECTION_NAMES, k)).otherwise(F.initcap(F.col("n_name")))
    return n.select((k + 1).cast("bigint").alias("id"), name.alias("name"),
                    F.lower(F.replace(name, F.lit(" "), F.lit("-"))).alias("slug"))


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.struct(F.col("p_name").alias("rendered")).alias("title"))


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        F.concat(F.lit("ph"), k.cast("string")).alias("id"),
        k.alias("ord"),
        F.lower(F.concat_ws(" ", F.col("p_type"), F.replace(F.col("p_brand"), F.lit("#"), F.lit(" "))))
        .alias("description"),
        F.when(k % 13 == 0, F.lit(None).cast("bigint")).otherwise(F.col("p_retailprice").cast("bigint")).alias("downloads"),
        F.struct(F.concat(F.lit("https://img.example.com/"), k.cast("string"), F.lit(".jpg")).alias("regular")).alias("urls"),
        F.struct(F.concat(F.lit("user"), (k % 50).cast("string")).alias("name")).alias("user"),
    )


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested video listing items (``id.videoId``, ``snippet.*``)."""
    p = table(spark, sf_dir, "pages")
    pid = F.col("page_id")
    vid = F.when(pid % 13 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("v"), pid.cast("string")))
    title = F.regexp_extract(F.col("html"), "<h1>(.*?)</h1>", 1)
    thumb = F.when(pid % 5 == 0, F.lit(None)).otherwise(
        F.struct(F.struct(F.concat(F.lit("https://img.example.com/v/"), pid.cast("string"), F.lit(".jpg"))
                          .alias("url")).alias("high")))
    published = F.date_format(minutes_before((pid % 72) * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return p.select(
        pid.alias("page_id"),
        (pid % 3).alias("channel"),
        F.struct(vid.alias("videoId")).alias("id"),
        F.struct(title.alias("title"),
                 F.when(pid % 7 == 0, F.lit("  \nsecond line")).otherwise(
                     F.concat(F.lit("Line one\n"), F.col("url"))).alias("description"),
                 published.alias("publishedAt"),
                 thumb.alias("thumbnails")).alias("snippet"),
    )


LISTING_LENGTH = 50


def _land_texts(files: DataFrame, root: str) -> None:
    """One file for each (file, value), and one more with the first value cut off."""
    first = files.agg(F.min_by("value", "file").alias("value"))
    broken = first.select(F.lit(-1).cast("bigint").alias("file"),
                          F.substr(F.col("value"), F.lit(1), (F.length("value") * 2 / 3).cast("int")).alias("value"))
    files.unionByName(broken).write.option("maxRecordsPerFile", 1).partitionBy("file").text(root)


def land_videos(spark: SparkSession, sf_dir: str, root: str) -> None:
    """``videos`` landed as listing answers of ``LISTING_LENGTH`` pages each, with
    the keys around them; NULL fields are left out, as an API does."""
    item = F.struct(F.lit("video").alias("kind"), F.col("id"), F.struct(
        F.col("channel").cast("string").alias("channelId"), *[F.col(f"snippet.{c}") for c in
                                                              ("title", "description", "publishedAt", "thumbnails")]).alias("snippet"))
    listing = F.to_json(F.struct(F.lit("listing").alias("kind"), F.array_sort(F.collect_list("item")).alias("items")),
                        {"pretty": "true"})
    _land_texts(videos(spark, sf_dir).select(F.floor(F.col("page_id") / LISTING_LENGTH).alias("file"), item.alias("item"))
                .groupBy("file").agg(listing.alias("value")), root)


def land_posts(spark: SparkSession, sf_dir: str, root: str) -> None:
    """``cms_posts`` landed as listing answers."""
    posts = cms_posts(spark, sf_dir)
    item = F.struct("id", "title", "excerpt", "link", "categories", "status", F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss").alias("date"),
                    F.lit("open").alias("comment_status"))
    _land_texts(posts.select(F.floor(F.col("id") / LISTING_LENGTH).alias("file"), item.alias("item"))
                .groupBy("file").agg(F.to_json(F.array_sort(F.collect_list("item")), {"pretty": "true"}).alias("value")), root)
