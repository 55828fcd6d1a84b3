"""Operator behaviour on hand-made tables (FIXTURES §3) and plan checks."""

from pyspark.sql import functions as F

from tidewire.operators import ingest as I
from tidewire.operators import requests as RQ
from tidewire.operators import review as RV
from tidewire.operators import routing as RT


def test_first_seen_before_filters(spark):
    # stale first copy hides a later fresh copy of the same URL
    rows = [(1, "u1", 0, 1, "2024-01-29 00:00:00"), (2, "u1", 1, 1, "2024-01-30 23:00:00"),
            (3, "u2", 0, 2, "2024-01-30 23:00:00")]
    df = (spark.createDataFrame(rows, "id long, url string, source_ord int, item_ord long, p string")
          .withColumn("published_at", F.to_timestamp("p")).withColumn("url_hash", F.sha2("url", 256)))
    out = I.fresh(I.first_seen(df), F.to_timestamp(F.lit("2024-01-31 00:00:00")))
    assert sorted(r.id for r in out.collect()) == [3]


def test_insert_if_absent(spark):
    batch = spark.createDataFrame(
        [(1, "a", "ha", 0, 1), (2, "a", "ha", 0, 2), (3, "b", "hb", 0, 3), (4, None, None, 0, 4)],
        "id long, url string, url_hash string, source_ord int, item_ord long")
    store = spark.createDataFrame([("b", "hb")], "url string, url_hash string")
    got = sorted(r.id for r in I.insert_if_absent(batch, store).collect())
    assert got == [1, 4]
    counts = I.insert_counts(batch, I.insert_if_absent(batch, store)).first()
    assert (counts.inserted, counts.skipped) == (2, 2)


def test_approval_fold_state_machine(spark):
    sheet = spark.createDataFrame([
        (1, "7", "APPROVE", "a"), (2, "7", "reject", "no"), (3, "7", "yes", "b"),   # stays rejected
        (4, "8", "EDIT", "e"), (5, "8", " Yes ", "y"),                            # last wins
        (6, "9", "maybe", "?"), (7, "x9", "APPROVE", ""), (8, "", "APPROVE", ""),  # ignored rows
        (9, "10", "approve", ""), (10, "11", "approve", ""), (11, "12", "approve", ""),
    ], "row_ord long, draft_id string, approval string, notes string")
    dec = RV.read_decisions(sheet)
    s = RV.approval_summary(dec).first()
    assert (s.approved, s.rejected, s.edited, s.skipped) == (6, 1, 1, 1)
    fold = {r.draft_id: (r.status, r.notes) for r in RV.approval_fold(dec).collect()}
    assert fold[7] == ("rejected", "no") and fold[8] == ("pending_publisher", "y") and 9 not in fold
    drafts = spark.createDataFrame([(7, "pending_editor"), (8, "needs_edit"), (10, "published"),
                                    (11, None), (12, "rejected")], "id long, status string")
    out = {r.id: (r.status, r.updated) for r in RV.apply_decisions(drafts, RV.approval_fold(dec)).collect()}
    assert out[7] == ("rejected", True) and out[8] == ("pending_publisher", True)
    assert out[10] == ("published", False) and out[11] == (None, False) and out[12] == ("rejected", False)


def test_url_types(spark):
    rules = spark.createDataFrame([("x.com", "twitter", "", "exact"), ("fb.com", "blocked_social", "", "exact"),
                                   ("paper.com", "paywall", "Paper", "suffix")],
                                  "domain string, kind string, label string, match string")
    req = spark.createDataFrame([(1, "https://www.x.com/a"), (2, "https://news.paper.com/a"),
                                 (3, "https://m.fb.com/"), (4, "https://sub.x.com/a"), (5, "nonsense")],
                                "row_ord long, url string")
    got = {r.row_ord: (r.url_type, r.label) for r in RQ.url_types(req, rules).collect()}
    assert got == {1: ("twitter", ""), 2: ("paywall", "Paper"), 3: ("article", ""),
                   4: ("article", ""), 5: ("article", "")}


def test_extract_page():
    html = ("<html><head><title>T &amp; U</title><script>var t='</p>';</script></head><body>"
            "<nav><h1>menu</h1></nav><article><h1>Main title</h1>"
            "<p>" + "a" * 50 + "<p>" + "b" * 60 + "</p><p>short</p><figure><p>" + "c" * 80 + "</p></figure>"
            "</article><footer>f</footer></body></html>")
    title, body, err = RQ.extract_page(html)
    assert err is None and title == "Main title"
    # body shorter than 200 chars -> all container text
    assert "a" * 50 in body and "b" * 60 in body and "c" * 80 not in body
    long_html = "<main>" + "".join(f"<p>{'w' * 45} {i}</p>" for i in range(6)) + "</main>"
    t2, b2, e2 = RQ.extract_page(long_html)
    assert e2 is None and t2 == "" and b2.count("\n\n") == 5
    assert RQ.extract_page("<div>no container</div>")[2] == RQ.NO_CONTAINER


def test_route_categories_zero_id_and_blocked(spark):
    cats = spark.createDataFrame([(1, "Breaking News", "breaking-news"), (2, "Politics", "politics"),
                                  (3, "Opinion", "opinion"), (4, "Tech and Science", "tech-and-science")],
                                 "id long, name string, slug string")
    drafts = spark.createDataFrame([(1, "Politics"), (2, "Technology"), (3, "Opinion"), (4, "Unknown")],
                                   "id long, category string")
    got = {r.id: r.category_ids for r in RT.route_categories(drafts, cats).collect()}
    assert got == {1: [1, 2], 2: [1, 4], 3: [1], 4: [1]}


def test_top_stories_plan(spark):
    from tidewire.operators import ranking as R
    df = spark.createDataFrame([(i, float(i % 3)) for i in range(20)], "id long, priority_score double")
    plan = R.top_stories(df)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_extract_page_unclosed_noise_and_empty_h1():
    from tidewire.operators.requests import extract_page

    body = "A paragraph that is long enough to count as the main text of this page. " * 4
    for head in ("<div><nav>menu</div>", "<header><form></header>", "<nav>menu</nav>"):
        title, text, error = extract_page(f"<html><title>T</title><body>{head}<article><p>{body}</p></article></body></html>")
        assert (title, error) == ("T", None) and body.strip() in text and "menu" not in text
    assert extract_page(f"<title>T</title><body><h1></h1><p>{body}</p></body>")[0] == ""


def test_first_seen_keeps_one_row_of_ties(spark):
    from tidewire.operators.ingest import first_seen

    rows = [("k", 1, 1, "a"), ("k", 1, 1, "b"), ("n", None, None, "c"), ("n", None, None, "c"), ("n", None, None, "d")]
    df = spark.createDataFrame(rows, "url_hash string, source_ord int, item_ord int, title string")
    assert sorted(r.url_hash for r in first_seen(df).collect()) == ["k", "n"]
