"""Edge-case tables for the column expressions."""

from pyspark.sql import functions as F

from tidewire.functions import dates as D
from tidewire.functions import scoring as S
from tidewire.functions import text as T
from tidewire.operators import drafting as DR
from tidewire.operators import media as MD


def one(spark, col, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("y")).first()[0]


def test_strip_and_clean(spark):
    assert one(spark, T.strip_ws("x"), "  hi there \n") == "hi there"
    assert one(spark, T.clean_text("x"), "<p>a</p> \n b") == "a b"
    assert one(spark, T.word_count("x"), "<p>one two</p><p>three</p>") == 3


def test_html_to_readable(spark):
    html = "<h2>Head</h2><p>First</p><br/><p>Second</p>\n\n\n\n<b>x</b>"
    out = one(spark, T.html_to_readable("x"), html)
    assert out.startswith("### Head") and "\n\n\n" not in out and "<" not in out


def test_decode_order(spark):
    assert one(spark, T.decode_entities("x"), "<b>a &amp;lt; b</b>&nbsp;") == "a < b"


def test_truncate(spark):
    short = "x" * 160
    assert one(spark, T.truncate_word("x"), short) == short
    long_sp = "word " * 40
    out = one(spark, T.truncate_word("x"), long_sp)
    assert out.endswith("...") and len(out) <= 163 and not out[:-3].endswith(" ")
    nospace = "y" * 200
    assert one(spark, T.truncate_word("x"), nospace) == "y" * 160 + "..."


def test_url_domain(spark):
    assert one(spark, T.url_domain("x"), "https://WWW.Example.com:8080/a?b") == "example.com:8080"
    assert one(spark, T.url_domain("x"), "not a url") == ""
    assert one(spark, T.url_domain("x"), "http://user@www.site.org/") == "user@www.site.org"


def test_headline_words(spark):
    assert one(spark, T.headline_words("x"), "  Big storms hit coastal towns today") == ["storms", "coastal", "towns"]


def test_parse_published(spark):
    cases = {
        "Tue, 31 Mar 2026 06:00:00 +0100": "2026-03-31 05:00:00",
        "Tue, 31 Mar 2026 06:00:00 GMT": "2026-03-31 06:00:00",
        "2026-03-31T06:00:00Z": "2026-03-31 06:00:00",
        "junk": None,
        None: None,
    }
    for raw, want in cases.items():
        assert one(spark, D.iso_seconds(D.parse_published("x")), raw) == want, raw


def test_recency_and_score(spark):
    df = spark.createDataFrame([("2024-01-30 20:00:00",), ("2024-01-30 10:00:00",), (None,),
                                ("2024-02-02 00:00:00",)], "p string")
    asof = F.to_timestamp(F.lit("2024-01-31 00:00:00"))
    got = [r[0] for r in df.select(S.recency_score(F.to_timestamp("p"), asof)).collect()]
    assert got == [1.0, 0.5, 0.3, 1.0]


def test_categorise_ties_and_fallback(spark):
    tax = [("A", ["xx"]), ("B", ["yy"]), ("C", ["xx", "zz"])]
    df = spark.createDataFrame([("xx yy", ""), ("xx zz", ""), ("none", ""), ("YY", "")], "t string, s string")
    got = [r[0] for r in df.select(S.categorise("t", "s", tax)).collect()]
    assert got == ["A", "C", "General", "B"]


def test_validate_override(spark):
    df = spark.createDataFrame([(" Politics ",), ("",), ("Breaking News",), ("opinion",), ("weather",)], "x string")
    got = [(r.v.key, r.v.err is not None) for r in df.select(S.validate_override("x").alias("v")).collect()]
    assert got == [("politics", False), (None, False), (None, False), (None, True), (None, True)]


def test_extract_json_text(spark):
    cases = {
        '```json\n{"a": 1}\n```': '{"a": 1}',
        'Sure! {"a": 1} done': '{"a": 1}',
        '  {"a": 1}  ': '{"a": 1}',
        'no braces': 'no braces',
    }
    for raw, want in cases.items():
        assert one(spark, DR.extract_json_text(F.col("x")), raw) == want


def test_parse_answer_with_raw_newline(spark):
    df = spark.createDataFrame([(1, '{"headline": "H", "body": "line1\nline2", "category": "C"}'),
                                (2, '{"headline": "H"}'), (3, "nope")], "request_id long, raw string")
    got = {r.request_id: (r.ok, r.body) for r in DR.parse_answers(df).collect()}
    assert got[1] == (True, "line1\nline2")
    assert got[2][0] is False and got[3][0] is False


def test_keyword_list(spark):
    df = spark.createDataFrame([('["a","b","c","d"]', "Big storms hit towns", "World"),
                                ("not json", "Big storms hit towns", "World"),
                                ("[]", "tiny", "World")], "k string, h string, c string")
    got = [r[0] for r in df.select(MD.keyword_list("k", "h", "c")).collect()]
    assert got == [["a", "b", "c"], ["storms", "towns", "World"], ["World"]]
