"""Ingest operators: W1, F1-F3, A1, S5, A9, J1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire import config as C
from tidewire.functions import dates as D
from tidewire.functions import scoring as S
from tidewire.functions import text as T
from tidewire.session import materialize


def _place(items: DataFrame, order: tuple[str, ...]) -> Column:
    """A row's place among the copies of its key; rows of equal order are told
    apart by their content."""
    return F.struct(*[F.col(c) for c in order], F.xxhash64(*items.columns).alias("_content"))


def _at_first(rows: DataFrame, keyed: DataFrame, key: str) -> DataFrame:
    """The ``rows`` that hold the least ``_ord`` of their key in ``keyed``."""
    firsts = keyed.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("_ord").alias("_first"))
    return (rows.join(firsts, (rows[key] == firsts[key]) & (rows["_ord"] == firsts["_first"]), "left_semi")
            .dropDuplicates([key]))


def first_seen(items: DataFrame, key: str = "url_hash",
               order: tuple[str, ...] = ("source_ord", "item_ord"), order_col: str | None = None) -> DataFrame:
    """Keep the first occurrence of ``key`` in (source, item) order.

    It is decided over all rows, before the freshness/relevance filters: a
    stale first copy hides a later fresh one.  Written as an aggregation (min
    of the order struct, then a semi join) so that a key repeated by a third of
    all rows is combined map-side instead of landing in one window partition.
    ``order_col``: keep the row's place in that order under this name.
    """
    keyed = items.withColumn("_ord", _place(items, order))
    out = _at_first(keyed, keyed, key)
    return out.withColumnRenamed("_ord", order_col) if order_col else out.drop("_ord")


def has_link(items: DataFrame, col: str = "url") -> DataFrame:
    """drop rows without a URL (NULL or '')."""
    return items.where(F.col(col).isNotNull() & (F.col(col) != ""))


def fresh(items: DataFrame, as_of: Column, col: str = "published_at",
          max_age_hours: int = C.MAX_AGE_HOURS) -> DataFrame:
    """unknown date passes; else published within ``max_age_hours``."""
    cutoff = F.timestamp_seconds(F.unix_seconds(as_of) - max_age_hours * 3600)
    return items.where(F.col(col).isNull() | (F.col(col) >= cutoff))


def relevant(items: DataFrame, title: str = "title", summary: str = "summary",
             taxonomy=C.TAXONOMY) -> DataFrame:
    """at least one keyword occurs in ``lower(title + ' ' + summary)``.
    The lowered text is projected once and shared by all keyword tests."""
    return (items.withColumn("_topic", S.topic_text(title, summary))
            .where(S.is_relevant_text("_topic", taxonomy)).drop("_topic"))


def classify(items: DataFrame, title: str = "title", summary: str = "summary",
             taxonomy=C.TAXONOMY) -> DataFrame:
    """A1: add ``category``."""
    return (items.withColumn("_topic", S.topic_text(title, summary))
            .withColumn("category", S.categorise_text("_topic", taxonomy)).drop("_topic"))


def relevant_classified(items: DataFrame, title: str = "title", summary: str = "summary",
                        taxonomy=C.TAXONOMY) -> DataFrame:
    """F3 + A1 in one pass over the text.

    The keyword hits computed for A1 also decide F3 (any hit at all).  The
    row is kept through a 0-or-1-element ``explode`` rather than a Filter: a
    Filter would be pushed below the projection with the whole
    classification inlined into it, scanning every text twice."""
    def classify_text(t: Column) -> Column:
        return S.let(S.category_hits(t, taxonomy), lambda h: F.struct(
            F.exists(h, lambda x: x["hits"] > 0).alias("relevant"),
            S.best_category(h).alias("category")))
    cls = S.let(S.topic_text(title, summary), classify_text)
    kept = F.explode(F.filter(F.array(cls), lambda c: c["relevant"])).alias("_cls")
    cols = [c for c in items.columns if c != "category"]
    return items.select(*cols, kept).select(*cols, F.col("_cls.category").alias("category"))


def judged(items: DataFrame, as_of: Column, taxonomy=C.TAXONOMY) -> DataFrame:
    """F2, F3 and A1 as columns in place of filters: ``kept`` and ``category``."""
    cutoff = F.timestamp_seconds(F.unix_seconds(as_of) - C.MAX_AGE_HOURS * 3600)
    recent = F.col("published_at").isNull() | (F.col("published_at") >= cutoff)
    cls = S.let(S.let(S.topic_text("title", "summary"), lambda t: S.category_hits(t, taxonomy)), lambda h: F.struct(
        F.exists(h, lambda x: x["hits"] > 0).alias("relevant"), S.best_category(h).alias("category")))
    return (items.withColumn("_cls", cls).withColumn("kept", recent & F.col("_cls.relevant"))
            .withColumn("category", F.col("_cls.category")).drop("_cls"))


def feed_articles(entries: DataFrame) -> DataFrame:
    """S1 -> P1, P2, D1: scanned feed items as article rows (missing texts are
    '', the published date falls back to the updated one)."""
    title, summary = (T.strip_ws(F.coalesce(F.col(c), F.lit(""))) for c in ("title", "summary"))
    rest = [c for c in entries.columns if c not in ("link", "title", "summary", "published", "updated")]
    return (entries.select(*rest, F.col("link").alias("url"), T.url_hash("link").alias("url_hash"),
                           title.alias("title"), summary.alias("summary"),
                           D.coalesce_published("published", "updated").alias("published_at"))
            .withColumn("raw_content", F.col("summary")))


def ingest(items: DataFrame, as_of: Column, taxonomy=C.TAXONOMY,
           order: tuple[str, ...] = ("source_ord", "item_ord"), narrow: bool = False) -> DataFrame:
    """W1 -> F1 -> F2 -> F3 -> A1 over feed-level article rows.

    Output is the article snapshot (S2 shape) — one row per new URL; ``narrow``:
    with ``summary_len`` in place of the texts, for steps that need no more.

    F2, F3 and A1 look at single rows, so they run where the rows are read;
    which copy of a URL is the first is found over the keys of all rows, and
    only rows that pass the filters are shuffled to meet it."""
    if "url_hash" not in items.columns:
        items = items.withColumn("url_hash", T.url_hash("url"))
    items = has_link(items)
    keyed = items.withColumn("_ord", _place(items, order))
    good = relevant_classified(fresh(keyed, as_of), taxonomy=taxonomy)
    if narrow:
        good = good.withColumn("summary_len", F.length(F.coalesce("summary", F.lit("")))).drop(*C.BULKY_COLUMNS)
    return _at_first(good, keyed, "url_hash").drop("_ord")


def _taken(rows: DataFrame, accepted: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``rows`` without those that hold a key of an accepted row."""
    for key in keys:
        rows = rows.join(accepted.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return rows


def first_wins(rows: DataFrame, order: str = "_ord", keys: tuple[str, ...] = ("url", "url_hash")) -> DataFrame:
    """The rows that survive when rows are taken in ``order`` and one is
    refused if any of its keys is taken by a row before it that was not refused
    itself.  A NULL key is never taken.  ``rows``: the keys and a unique order.

    A row that is first for all of its keys is certainly accepted, and every
    other holder of its keys is certainly refused; both leave, which can make
    others first, and so on until nothing is left.  Where keys determine each
    other one round does it; only rows whose keys conflict crosswise take more."""
    left = materialize(rows, "first-wins")
    accepted = None
    while True:
        marked = left
        firsts = []
        for i, key in enumerate(keys):
            least = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias(f"_f{i}"))
            marked = marked.join(least, key, "left")
            firsts.append(F.col(key).isNull() | (F.col(order) == F.col(f"_f{i}")))
        first_of_all = firsts[0]
        for f in firsts[1:]:
            first_of_all = first_of_all & f
        won = marked.where(first_of_all).select(*rows.columns)
        accepted = won if accepted is None else accepted.unionByName(won)
        left = materialize(_taken(marked.where(~first_of_all).select(*rows.columns), won, keys), "first-wins")
        if left.isEmpty():
            return accepted


def insert_if_absent(batch: DataFrame, stored: DataFrame,
                     order: tuple[str, ...] = ("source_ord", "item_ord")) -> DataFrame:
    """Rows of ``batch`` inserted one by one in ``order`` into a store
    with unique ``url`` and ``url_hash``: a row is skipped if either is stored or
    was inserted before it.

    Skipped rows take no key, so with (u1, h1), (u2, h1), (u2, h3) the first and
    the third row are inserted (``first_wins``).  A NULL url/url_hash is never a
    repeat (SQL UNIQUE admits many NULLs).  Rows of equal order are told apart
    by their content; of identical rows one is inserted, or all if both keys
    are NULL.  Both store lookups are anti joins: AQE broadcasts the store side
    when it is small and falls back to a shuffle join when it is not; of each
    (url, url_hash) of the batch only the first row's keys and order reach them."""
    keys = ("url", "url_hash")
    ordk = F.struct(*[F.col(c) for c in order], F.xxhash64(*batch.columns).alias("_h1"),
                    F.xxhash64(*batch.columns, F.lit(1)).alias("_h2"))
    keyed = batch.withColumn("_ord", ordk)
    free = F.col("url").isNull() & F.col("url_hash").isNull()
    pairs = keyed.where(~free).groupBy(*keys).agg(F.min("_ord").alias("_ord"))
    won = first_wins(_taken(pairs, stored, keys).select(*keys, "_ord"))
    a, w = keyed.where(~free).alias("a"), won.alias("w")
    inserted = (a.join(w, (F.col("a._ord") == F.col("w._ord")) & F.col("a.url").eqNullSafe(F.col("w.url"))
                       & F.col("a.url_hash").eqNullSafe(F.col("w.url_hash")), "left_semi")
                .dropDuplicates(list(keys)))
    return inserted.unionByName(keyed.where(free)).drop("_ord")


def insert_counts(batch: DataFrame, inserted: DataFrame) -> DataFrame:
    """Inserted / skipped counts of one store run, as one aggregation over
    the tagged union of batch rows and inserted rows."""
    tagged = batch.select(F.lit(0).alias("_ins")).unionByName(inserted.select(F.lit(1).alias("_ins")))
    return tagged.agg(F.sum("_ins").cast("bigint").alias("inserted"),
                      (F.count_if(F.col("_ins") == 0) - F.sum("_ins")).cast("bigint").alias("skipped"))


def per_source_counts(items: DataFrame) -> DataFrame:
    """Relevant items per source."""
    return items.groupBy("source").agg(F.count(F.lit(1)).alias("n_items"))
