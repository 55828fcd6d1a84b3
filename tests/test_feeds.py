"""S1 on real feed forms, D1 date forms, S4/F4 by folder names."""

import os

import pytest
from pyspark.sql import functions as F

from tidewire.functions import dates as D
from tidewire.operators import ingest as I
from tidewire.sources import io as IO

RSS = """<?xml version="1.0" encoding="UTF-8"?>
<rss version="2.0" xmlns:atom="http://www.w3.org/2005/Atom" xmlns:content="http://purl.org/rss/1.0/modules/content/"
  xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>T</title><link>https://site/</link>
<atom:link href="https://site/rss" rel="self"/>
<item><title>First &amp; best</title><link> https://site/1 </link><description><![CDATA[<p>Body</p>]]></description>
<pubDate>Tue, 30 Jan 24 20:00:00 EST</pubDate><guid isPermaLink="false">x1</guid></item>
<item><title>No link</title><guid>https://site/guid</guid><content:encoded>Long</content:encoded><dc:date>2024-01-30</dc:date></item>
<item><title/><link/><description/></item></channel></rss>"""
ONE = "<rss><channel><item><title>One</title><link>https://one/</link></item></channel></rss>"
ATOM = """<?xml version="1.0"?>
<feed xmlns="http://www.w3.org/2005/Atom"><title>A</title><link href="https://a/"/>
<entry><title type="html">Entry</title><link rel="edit" href="https://a/edit"/><link href="https://a/1"/>
<summary type="html">S</summary><updated>2024-01-30T10:00:00Z</updated></entry>
<entry><title>Two</title><link rel="alternate" href="https://a/2"/><content type="text">C</content>
<published>2024-01-30T10:00:00.123+02:00</published></entry></feed>"""
RDF = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/">
<channel><title>R</title></channel><item><title>R1</title><link>https://r/1</link></item></rdf:RDF>"""
LATIN = '<?xml version="1.0" encoding="ISO-8859-1"?><rss><channel><item><title>Café</title><link>https://l/</link></item></channel></rss>'


@pytest.fixture(scope="module")
def scanned(spark):
    root = IO.scratch_dir(spark, "feeds").removeprefix("file:")
    for source, text in (("rss", RSS), ("one", ONE), ("atom", ATOM), ("rdf", RDF), ("cut", RSS[:600]), ("html", "<html><p>Not found"),
                         ("other", "<page><p>x</p></page>"), ("empty", ""), ("quiet", "<rss><channel><title>T</title></channel></rss>")):
        os.makedirs(f"{root}/source={source}")
        with open(f"{root}/source={source}/feed.xml", "w", encoding="utf-8") as f:
            f.write(text)
    os.makedirs(f"{root}/source=latin")
    with open(f"{root}/source=latin/feed.xml", "wb") as f:
        f.write(LATIN.encode("latin-1"))
    return IO.scan_feeds(spark, root)


def test_items_of_every_form(scanned):
    got = {(r.source, r.item_ord): r for r in IO.feed_entries(scanned).collect()}
    assert set(got) == {("rss", 0), ("rss", 1), ("rss", 2), ("one", 0), ("atom", 0), ("atom", 1), ("rdf", 0), ("latin", 0)}
    r = got["rss", 0]
    assert (r.link, r.title, r.summary.strip(), r.published) == ("https://site/1", "First & best", "<p>Body</p>", "Tue, 30 Jan 24 20:00:00 EST")
    r = got["rss", 1]
    assert (r.link, r.summary, r.published) == ("https://site/guid", "Long", "2024-01-30")
    assert not got["rss", 2].link
    r = got["atom", 0]
    assert (r.link, r.title, r.summary, r.published, r.updated) == ("https://a/1", "Entry", "S", None, "2024-01-30T10:00:00Z")
    assert (got["atom", 1].link, got["atom", 1].summary) == ("https://a/2", "C")
    assert got["rdf", 0].link == "https://r/1" and got["one", 0].title == "One"
    assert got["latin", 0].title == "Café"


def test_broken_files_are_set_aside(scanned):
    got = {r.source: r.error for r in IO.feed_quarantine(scanned).collect()}
    assert set(got) == {"cut", "html", "other"}
    assert got["cut"] == "malformed XML" and got["other"] == "no feed"


def test_articles_of_feeds(scanned):
    rows = {r.url: r for r in I.feed_articles(IO.feed_entries(scanned)).collect()}
    assert str(rows["https://site/1"].published_at) == "2024-01-31 01:00:00"
    assert str(rows["https://a/1"].published_at) == "2024-01-30 10:00:00"  # by the updated date
    assert str(rows["https://a/2"].published_at) == "2024-01-30 08:00:00.123000"
    assert rows["https://r/1"].summary == "" and rows["https://r/1"].published_at is None


@pytest.mark.parametrize("raw, want", [
    ("Tue, 30 Jan 2024 20:00:00 +0100", "2024-01-30 19:00:00"), ("30 Jan 2024 20:00 GMT", "2024-01-30 20:00:00"),
    ("Tue, 30 Jan 2024 20:00:00 EST", "2024-01-31 01:00:00"), ("Tue, 30 Jan 2024 20:00:00 PDT", "2024-01-31 03:00:00"),
    ("Tue, 30 Jan 24 20:00:00 GMT", "2024-01-30 20:00:00"), ("1 Feb 99 01:02:03 GMT", "1999-02-01 01:02:03"),
    ("Tue, 30 Jan 2024 20:00:00", "2024-01-30 20:00:00"), ("2024-01-30", "2024-01-30 00:00:00"),
    ("2024-01-30T20:00:00", "2024-01-30 20:00:00"), ("2024-01-30T20:00Z", "2024-01-30 20:00:00"),
    ("2024-01-30T20:00:00.5Z", "2024-01-30 20:00:00"), ("2024-01-30T20:00:00.500Z", "2024-01-30 20:00:00"),
    ("2024-01-30T20:00:00+02:00", "2024-01-30 18:00:00"), ("2024-01-30T20:00:00+0200", "2024-01-30 18:00:00"),
    ("2024-01-30 20:00:00", "2024-01-30 20:00:00"), ("sometime", None), ("", None), (None, None), ("99 Foo 2024 25:00:00 GMT", None),
])
def test_date_forms(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "p string")
    assert df.select(D.iso_seconds(D.parse_published("p"))).first()[0] == want


def test_only_the_range_is_listed_and_opened(spark):
    root = IO.scratch_dir(spark, "days").removeprefix("file:")
    rows = spark.range(10).select(
        "id", *[F.lit("x").alias(c) for c in ("url", "url_hash", "source", "title", "summary")],
        F.lit(None).cast("timestamp").alias("published_at"),
        F.timestamp_seconds(F.lit(1_706_572_800) + F.col("id") * 6 * 3600).alias("fetched_at"),  # from 2024-01-30 00:00
        F.lit("c").alias("category"), F.lit("r").alias("raw_content"))
    IO.write_snapshot_days(rows, root)
    os.makedirs(f"{root}/ingest_date=2024-01-01")
    for day in ("2024-01-01", "2024-01-30"):  # not parquet: opening it fails
        with open(f"{root}/ingest_date={day}/part-broken.parquet", "w") as f:
            f.write("no parquet")
    assert IO.partition_values(spark, root) == ["2024-01-01", "2024-01-30", "2024-01-31", "2024-02-01"]
    latest = IO.latest_snapshot(spark, root)
    assert sorted(r.id for r in latest.collect()) == [8, 9]
    window = IO.read_window(spark, root, "2024-02-01 12:00:00", 26)
    assert sorted(r.id for r in window.collect()) == [6, 7, 8, 9]
    for df in (latest, window):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(ingest_date" in plan or "PartitionFilters: [ingest_date" in plan
    assert IO.read_window(spark, root, "2024-03-01 00:00:00", 26).count() == 0
    with pytest.raises(FileNotFoundError):
        IO.latest_snapshot(spark, root + "-none")
