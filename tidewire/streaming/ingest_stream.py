"""Structured Streaming ingest: T1-T5.

Landed files are a file source (explicit schema); each micro-batch runs the
batch operators and adds what is new to a bucketed store (T3) by
``foreachBatch``.  The store holds the first copy of every URL seen so far,
also of those that the filters refuse, so a stale first copy hides a later
fresh one whichever file it came in.  ``trigger(availableNow=True)`` drains
what has landed and stops — the same code serves a continuous trigger."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators import ingest as I
from tidewire.session import ensure_checkpoint_dir
from tidewire.streaming.store import BucketedStore

BUCKETS = 16
ORDER = ("source_ord", "item_ord")


def article_store(spark: SparkSession, path: str, items: DataFrame) -> BucketedStore:
    """The store of the first copies of ``items``' URLs: url_hash, the order of
    the copy, whether it is kept, its category, and the item (NULLs if refused)."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema if f.name != "url_hash")
    order = "struct<" + ", ".join(f"{c}: {items.schema[c].dataType.simpleString()}" for c in ORDER) + ", _content: bigint>"
    return BucketedStore(spark, path, f"url_hash string, first {order}, kept boolean, category string, {columns}",
                         "url_hash", BUCKETS)


def stored_articles(store: BucketedStore) -> DataFrame:
    """The snapshot that ingesting all items at once gives: of each URL the
    least copy in (source, item) order, if it is kept.  One aggregation within
    the buckets."""
    rest = [c for c in store.columns if c not in ("url_hash", "first")]
    return (store.rows().groupBy("url_hash").agg(F.min_by(F.struct(*rest), "first").alias("x"))
            .where("x.kept").select("url_hash", "x.*").drop("kept"))


def ingest_batch(batch: DataFrame, as_of: Column, store: BucketedStore, name: str,
                 lookup_hours: int | None = None) -> None:
    """One micro-batch: its first copies (W1) are judged (F1-F3, A1), and those
    that are new or come before the stored copy of their URL are added.

    ``lookup_hours``: look only at copies stored within that time before
    ``as_of``.  It bounds what a batch reads, not the result: an older copy
    that is met again is stored twice and still the least one counts."""
    if store.has(name):
        return
    firsts = I.first_seen(I.has_link(batch), order=ORDER, order_col="first")
    judged = I.judged(firsts, as_of)
    rest = [c for c in store.columns if c not in ("url_hash", "first", "kept", "category")]
    judged = judged.select("url_hash", "first", "kept", F.when(F.col("kept"), F.col("category")).alias("category"),
                           *[F.col(c) if c == "fetched_at" else F.when(F.col("kept"), F.col(c)).alias(c) for c in rest])
    known = store.rows()
    if lookup_hours is not None:
        known = known.where(F.col("fetched_at") >= F.timestamp_seconds(F.unix_seconds(as_of) - lookup_hours * 3600))
    known = known.groupBy("url_hash").agg(F.min("first").alias("_known"))
    new = (judged.repartition(store.buckets, "url_hash").join(known, "url_hash", "left")
           .where(F.col("_known").isNull() | (F.col("first") < F.col("_known"))).drop("_known"))
    store.commit(name, new)


def stream_ingest(items: DataFrame, as_of: Column, out_path: str, checkpoint: str) -> BucketedStore:
    """T1 + T3 + T4: every micro-batch through ``ingest_batch``.  F2 is the
    explicit freshness predicate (T4), so batch and stream agree.  A replayed
    batch is known by the ledger; a new checkpoint's batches are new names, whose
    rows are all stored already."""
    store = article_store(items.sparkSession, out_path, items)
    run = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def add(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, as_of, store, f"{run}-{batch_id:012d}")

    (items.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
    return store


def stream_dedup(items: DataFrame, ts_col: str, key: str, horizon: str, out_path: str,
                 checkpoint: str) -> None:
    """Key uniqueness inside a bounded horizon; the watermark bounds the
    state (timestamp_ntz is cast to timestamp first)."""
    q = (items.withColumn(ts_col, F.col(ts_col).cast("timestamp"))
         .withWatermark(ts_col, horizon).dropDuplicatesWithinWatermark([key])
         .writeStream.format("parquet").option("path", out_path)
         .option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()


def stream_counts(items: DataFrame, ts_col: str, out_path: str, checkpoint: str,
                  period: str = "1 day", lateness: str = "48 hours") -> None:
    """T5: items per source per tumbling period.

    Update mode under a watermark: the state holds the windows that can still
    change, and each trigger writes the changed ones (whole new counts) under
    its own ``batch``; a replayed trigger writes the same rows in the same
    place.  ``current_counts`` reads the last count of each window."""
    at = F.col(ts_col).cast("timestamp")
    agg = (items.withColumn("_at", at).withWatermark("_at", lateness)
           .groupBy(F.window("_at", period).alias("w"), "source").agg(F.count(F.lit(1)).alias("n_items"))
           .select(F.col("w.start").alias("window_start"), "source", "n_items"))

    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("window_day", F.date_format("window_start", "yyyy-MM-dd"))
         .write.mode("overwrite").partitionBy("window_day").parquet(f"{out_path}/batch={batch_id}"))

    (agg.writeStream.outputMode("update").foreachBatch(write)
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())


def current_counts(spark: SparkSession, out_path: str) -> DataFrame:
    """window_start, source, n_items: the last count written of each window."""
    schema = "window_start timestamp, source string, n_items bigint, window_day string, batch bigint"
    rows = spark.read.schema(schema).option("basePath", out_path).parquet(out_path)
    return (rows.groupBy("window_day", "window_start", "source")
            .agg(F.max_by("n_items", "batch").alias("n_items")).drop("window_day"))


def stream_dirs(spark: SparkSession, name: str) -> tuple[str, str]:
    from tidewire.sources.io import scratch_dir
    ensure_checkpoint_dir(spark)
    root = scratch_dir(spark, name)
    return os.path.join(root, "out"), os.path.join(root, "chk")
