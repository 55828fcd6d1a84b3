"""T1, T3, T5 over several landed files, in any order, with crashes and replays."""

import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from tidewire.operators import ingest as I
from tidewire.sources.io import scratch_dir
from tidewire.streaming import ingest_stream as ST
from tidewire.streaming.store import BucketedStore

SCHEMA = ("id long, source string, source_ord int, item_ord long, url string, url_hash string, title string, "
          "summary string, published_at timestamp, fetched_at timestamp, raw_content string")


def as_of():
    return F.to_timestamp(F.lit("2024-01-31 00:00:00"))


def items(spark, rows):
    df = spark.createDataFrame(rows, "id long, source_ord int, item_ord long, url string, title string, p string")
    return df.select("id", F.concat(F.lit("src"), "source_ord").alias("source"), "source_ord", "item_ord", "url",
                     F.sha2("url", 256).alias("url_hash"), "title", F.lit("war and a treaty").alias("summary"),
                     F.to_timestamp("p").alias("published_at"), F.to_timestamp(F.lit("2024-01-30 12:00:00")).alias("fetched_at"),
                     F.lit("raw").alias("raw_content"))


FRESH, STALE = "2024-01-30 20:00:00", "2024-01-01 00:00:00"
FILES = [
    [(1, 2, 1, "u1", "a", STALE), (2, 2, 2, "u2", "b", FRESH), (3, 2, 3, None, "no link", FRESH)],
    [(4, 1, 1, "u1", "c", FRESH), (5, 3, 1, "u2", "d", STALE), (6, 3, 2, "u3", "e", None)],
    [(7, 0, 1, "u2", "f", STALE), (8, 0, 2, "u3", "g", FRESH), (9, 3, 9, "u1", "h", FRESH), (10, 0, 3, "u4", "i", STALE)],
]


def land(spark, folder, files):
    """One file a micro-batch, in this order (by modification time)."""
    os.makedirs(folder)
    for i, rows in enumerate(files):
        part = f"{folder}/{i}"
        items(spark, rows).coalesce(1).write.parquet(part)
        name = next(n for n in os.listdir(part) if n.endswith(".parquet"))
        os.rename(f"{part}/{name}", f"{folder}/{i}.parquet")
        os.utime(f"{folder}/{i}.parquet", (1_700_000_000 + i * 60,) * 2)


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(folder)


def local(path):
    return path.removeprefix("file:")


def new_folder(spark, name):
    root = local(scratch_dir(spark, name))
    return f"{root}/in", f"{root}/out", f"{root}/chk"


@pytest.mark.parametrize("order", list(itertools.permutations(range(3))))
def test_stream_equals_batch_in_every_order(spark, order):
    want = sorted(tuple(r) for r in I.ingest(items(spark, sum(FILES, [])), as_of()).select("id", "url", "category").collect())
    folder, out, chk = new_folder(spark, "order")
    land(spark, folder, [FILES[i] for i in order])
    store = ST.stream_ingest(stream(spark, folder), as_of(), out, chk)
    assert len(store.batches()) == 3
    got = sorted(tuple(r) for r in ST.stored_articles(store).select("id", "url", "category").collect())
    assert got == want and [r[0] for r in want] == [4, 8]
    if order != (2, 0, 1):
        return
    store.compact()
    assert sorted(tuple(r) for r in ST.stored_articles(store).select("id", "url", "category").collect()) == want
    # a full replay under a new checkpoint adds no row
    before = store.rows().count()
    again = ST.stream_ingest(stream(spark, folder), as_of(), out, chk + "2")
    assert again.rows().count() == before


def test_random_files_equal_batch(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(4), rng.randrange(50), f"u{rng.randrange(25)}", f"t{i}", rng.choice([FRESH, STALE, None]))
            for i in range(120)]
    want = sorted(r.id for r in I.ingest(items(spark, rows), as_of()).collect())
    folder, out, chk = new_folder(spark, "random")
    land(spark, folder, [rows[k::4] for k in range(4)])
    store = ST.stream_ingest(stream(spark, folder), as_of(), out, chk)
    assert sorted(r.id for r in ST.stored_articles(store).collect()) == want


def test_crash_between_rows_and_ledger(spark, monkeypatch):
    folder, out, chk = new_folder(spark, "crash")
    land(spark, folder, FILES)
    plain, calls = BucketedStore._list, []

    def crash(self, name, replaces):
        calls.append(name)
        if len(calls) == 2:
            raise RuntimeError("lost")
        plain(self, name, replaces)

    monkeypatch.setattr(BucketedStore, "_list", crash)
    with pytest.raises(Exception, match="lost"):
        ST.stream_ingest(stream(spark, folder), as_of(), out, chk)
    half = ST.article_store(spark, out, stream(spark, folder))
    assert len(half.batches()) == 1  # rows of the second batch are there, but do not count
    store = ST.stream_ingest(stream(spark, folder), as_of(), out, chk)
    assert len(calls) == 4 and calls[1] == calls[2] and len(store.batches()) == 3
    assert sorted(r.id for r in ST.stored_articles(store).collect()) == [4, 8]
    # a batch that is listed is not run again, nor are its rows looked at
    monkeypatch.setattr(BucketedStore, "rows", lambda self: pytest.fail("read"))
    ST.ingest_batch(items(spark, FILES[0]), as_of(), store, calls[0])


def test_store_side_has_no_exchange(spark):
    folder, out, chk = new_folder(spark, "plan")
    store = ST.article_store(spark, out, items(spark, FILES[0]))
    for i, rows in enumerate(FILES):
        ST.ingest_batch(items(spark, rows), as_of(), store, f"b{i}")
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = ST.stored_articles(store)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Bucketed: true" in plan
        # another session finds the rows by the path alone
        spark.sql(f"DROP TABLE {store.table}")
        again = BucketedStore(spark, out, ST.article_store(spark, out + "-x", items(spark, FILES[0])).spark.table(
            ST.article_store(spark, out + "-x", items(spark, FILES[0])).table).drop("batch").schema.toDDL(), "url_hash", ST.BUCKETS)
        assert sorted(r.id for r in ST.stored_articles(again).collect()) == [4, 8]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


def test_lookup_bound_does_not_change_the_result(spark):
    folder, out, chk = new_folder(spark, "bound")
    store = ST.article_store(spark, out, items(spark, FILES[0]))
    for i, rows in enumerate(FILES * 2):
        ST.ingest_batch(items(spark, rows), as_of(), store, f"b{i}", lookup_hours=1)  # nothing is known
    assert sorted(r.id for r in ST.stored_articles(store).collect()) == [4, 8]


def test_counts_over_thirty_days(spark):
    folder, out, chk = new_folder(spark, "days")
    os.makedirs(folder)
    start = 1_704_067_200  # 2024-01-01 UTC
    for day in range(30):
        part = f"{folder}/{day}"
        (spark.range(40).select(F.timestamp_seconds(F.lit(start + day * 86400) + F.col("id") * 2000).alias("fetched_at"),
                                F.concat(F.lit("src"), F.col("id") % 4).alias("source"))
         .coalesce(1).write.parquet(part))
        name = next(n for n in os.listdir(part) if n.endswith(".parquet"))
        os.rename(f"{part}/{name}", f"{folder}/{day:02d}.parquet")
        os.utime(f"{folder}/{day:02d}.parquet", (1_700_000_000 + day * 60,) * 2)
    feed = (spark.readStream.schema("fetched_at timestamp, source string").option("maxFilesPerTrigger", 1)
            .option("pathGlobFilter", "*.parquet").parquet(folder))
    states = []
    from pyspark.sql.streaming import StreamingQueryListener

    class Watch(StreamingQueryListener):
        def onQueryStarted(self, event): ...
        def onQueryTerminated(self, event): ...
        def onQueryIdle(self, event): ...

        def onQueryProgress(self, event):
            states.extend(s.numRowsTotal for s in event.progress.stateOperators)

    watch = Watch()
    spark.streams.addListener(watch)
    try:
        ST.stream_counts(feed, "fetched_at", out, chk)
        got = {(str(r.window_start), r.source): r.n_items for r in ST.current_counts(spark, out).collect()}
    finally:
        spark.streams.removeListener(watch)
    want = {(str(r.w.start), r.source): r.n for r in spark.read.parquet(*[f"{folder}/{d:02d}.parquet" for d in range(30)])
            .groupBy(F.window("fetched_at", "1 day").alias("w"), "source").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == want and len(got) == 120
    assert not states or max(states) <= 4 * 5  # sources x open days, not 120
