"""Edges of link requests, embeds, model answers and JSON listings."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tidewire.operators import drafting as DR
from tidewire.operators import requests as RQ
from tidewire.sources import io as IO

RULES = "domain string, kind string, label string, match string, rule_ord int"


def types(spark, rules, urls):
    req = spark.createDataFrame(list(enumerate(urls)), "row_ord int, url string")
    return {r.row_ord: (r.url_type, r.label) for r in RQ.url_types(req, spark.createDataFrame(rules, RULES)).collect()}


def test_rule_order_and_depths(spark):
    rules = [("paper.co.uk", "paywall", "B", "suffix", 2), ("news.paper.co.uk", "paywall", "A", "suffix", 1),
             ("x.com", "twitter", "", "exact", 3), ("uk", "blocked_social", "", "exact", 4)]
    got = types(spark, rules, ["https://news.paper.co.uk/a", "https://www.paper.co.uk", "https://x.com/1", "https://a.x.com/",
                               "https://co.uk/", "https://uk/", "", None])
    assert got == {0: ("paywall", "A"), 1: ("paywall", "B"), 2: ("twitter", ""), 3: ("article", ""), 4: ("article", ""),
                   5: ("blocked_social", ""), 6: ("article", ""), 7: ("article", "")}
    assert types(spark, rules[2:3], ["https://x.com", "https://y.com"]) == {0: ("twitter", ""), 1: ("article", "")}
    assert types(spark, [("com", "paywall", "C", "suffix", 1)], ["https://any.com/"]) == {0: ("paywall", "C")}


def test_no_name_holds_all_com_domains(spark):
    """A rule of two labels: nothing is looked up under ``com``."""
    n = 4000
    domains = spark.range(n).select(F.when(F.col("id") % 10 < 9, F.concat(F.lit("a.site"), "id", F.lit(".com")))
                                    .otherwise(F.concat(F.lit("site"), "id", F.lit(".net"))).alias("domain"))
    rules = spark.createDataFrame([("site7.com", "paywall", "S", "suffix", 1)], RULES)
    plan = RQ.domain_types(domains, rules)._jdf.queryExecution().optimizedPlan().toString()
    assert "BroadcastNestedLoop" not in plan and "Cross" not in plan
    got = RQ.domain_types(domains, rules).collect()
    assert [tuple(r) for r in got] == [("a.site7.com", "paywall", "S")]


def outcomes(spark, fetches, pages, embeds=(), url="https://site.com/a"):
    pending = spark.createDataFrame([(1, url, "", "", "")], "row_ord int, url string, notes string, status string, category_override string")
    rules = spark.createDataFrame([("x.com", "twitter", "", "exact", 1)], RULES)
    f = spark.createDataFrame(fetches, "url string, http_status int, error string, try_ord int")
    x = spark.createDataFrame(pages, "url string, title string, body string, error string")
    e = spark.createDataFrame(list(embeds), "url string, author_line string, text string, error string")
    return [r.status for r in RQ.request_outcomes(pending, rules, f, x, e).collect()]


def test_one_outcome_a_request(spark):
    u = "https://site.com/a"
    page = [(u, "T", "body", None)]
    assert outcomes(spark, [(u, 500, None, 1), (u, 200, None, 2)], page) == ["Processed"]
    assert outcomes(spark, [(u, 500, None, 1)], page) == ["Error — HTTP 500"]
    assert outcomes(spark, [(u, 500, "timed out", 1), (u, 403, None, 2)], page) == [RQ.SKIP_BLOCKED]
    assert outcomes(spark, [(u, 200, None, 1)], [(u, "T", None, "bad"), *page, *page]) == ["Processed"]
    assert outcomes(spark, [(u, 200, None, 1)], []) == ["Error — " + RQ.NO_CONTAINER]
    post = "https://x.com/u/status/1"
    assert outcomes(spark, [], [], [(post, "A", "t", None), (post, "A", "", RQ.NO_POST_TEXT)], post) == ["Processed"]


def test_embed_entities(spark):
    html = "<blockquote><p>Fish &amp; chips &#8212; &#x1F600; &lt;b&gt; &amp;lt; &#xD800; &bogus; a&nbsp;b</p></blockquote>"
    df = spark.createDataFrame([("u", html, "N", "https://x/h/"), ("v", None, None, None), ("w", "<p></p>", "", "")],
                               "url string, html string, author_name string, author_url string")
    got = {r.url: r for r in RQ.embed_text(df).collect()}
    assert got["u"].text == "Fish & chips — 😀 <b> &lt; &#xD800; &bogus; a b" and got["u"].author_line == "N (@h)"
    assert got["w"].error == RQ.NO_POST_TEXT


GOOD = '{"headline": "H", "body": "B", "category": "C"'


@pytest.mark.parametrize("raw, ok", [
    (GOOD + "}", True), ("```json\n" + GOOD + "}\n```", True), ("Here: " + GOOD + "} done", True),
    (GOOD + "} and more", False), (GOOD + "} {}", False), (GOOD + "}, " + GOOD + "}", False),
    ("{'headline': 'H', 'body': 'B', 'category': 'C'}", False), ('{"headline": "H", "body": "B"}', False),
    (GOOD.replace("B", "line\nbreak") + "}", True), ("[" + GOOD + "}]", True), ("", False), (None, False), ("{", False),
    (GOOD + ', "image_keywords": "one"}', True), (GOOD + ', "image_keywords": null}', True),
])
def test_answers(spark, raw, ok):
    row = DR.parse_answers(spark.createDataFrame([(1, raw)], "request_id long, raw string")).first()
    assert row.ok == ok


def test_answer_keywords(spark):
    rows = [(1, GOOD + ', "image_keywords": "one"}'), (2, GOOD + ', "image_keywords": ["a", "b"]}'), (3, GOOD + "}"),
            (4, GOOD + ', "image_keywords": 7}'), (5, GOOD + ', "image_keywords": "[odd"}')]
    got = {r.request_id: r.image_keywords for r in DR.parse_answers(
        spark.createDataFrame(rows, "request_id long, raw string")).collect()}
    assert got == {1: ["one"], 2: ["a", "b"], 3: None, 4: ["7"], 5: ["[odd"]}


def test_json_listings(spark):
    root = IO.scratch_dir(spark, "listings").removeprefix("file:")
    os.makedirs(root)
    item = {"kind": "k", "id": {"videoId": "v1"}, "snippet": {"title": "T", "more": [1], "thumbnails": {}}}
    for name, text in (("a", json.dumps({"items": [item, {"id": {}}, {"id": {"videoId": "v2"}}], "etag": "x"}, indent=1)),
                       ("b", json.dumps({"items": []})), ("c", json.dumps({"error": "quota"})),
                       ("d", json.dumps({"items": [item]})[:40]), ("e", "no json")):
        with open(f"{root}/{name}.json", "w") as f:
            f.write(text)
    got = IO.read_video_feed(spark, root).collect()
    assert sorted(str(r.id.videoId) for r in got if r.id) == ["None", "v1", "v2"]
    broken = IO.json_quarantine(IO.scan_json(spark, root, IO.VIDEO_FEED_SCHEMA).cache()).collect()
    assert sorted(r.file[-6:] for r in broken) == ["d.json", "e.json"]
