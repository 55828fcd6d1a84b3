"""Sharding by fixed virtual slots (DataFrame functions only).

Every row hashes to one of ``slots`` virtual slots by its text, so equal texts
share a slot.  Bytes are summed per slot, and a slot-to-shard map sends whole
slots to shards, largest first to the least loaded.  A slot of more than
``1 / 2`` of a shard's fair share (a group of copies may hold a third of all
rows) is split into parts by a hash of identifier and text, as many as bring
each below an eighth.  Maps are small tables (``slots`` rows and the parts of
split slots) with a version; they can be stored, and rebalancing edits the
latest one: only slots that must move do.  Every version holds all slots and
all parts of split slots, those without rows too (0 bytes, dealt evenly), so
rows that come after a map was made have a place in it; a row without one is
an error.

Defined results: null text counts as empty (size 1); repeated rows are placed
one by one; null identifiers are ordinary; an empty table gives an empty
result and a map of empty slots; further columns are not read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.llm.common import Scratch

SLOTS = 4096
_MAP = "version int, vslot int, part int, parts int, bytes long, shard int"


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, vslot and the hash ``spread`` of each row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(text), F.lit(slots)).cast("int").alias("vslot"),
        F.xxhash64(F.col(id_col), text, F.lit(1)).alias("spread"))


def _part(parts: Column) -> Column:
    return F.pmod("spread", parts).cast("int")


def _by_size(column: Column) -> Column:
    """The array's (bytes, vslot, part, parts) in falling order of bytes."""
    return F.reverse(F.array_sort(column))


def slot_bytes(rows: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """vslot, part, parts, bytes: all slots, the large ones in all their parts."""
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    held = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"))
    whole = every.join(held, "vslot", "left").select("vslot", F.coalesce("bytes", F.lit(0)).alias("bytes"))
    fair = whole.agg((F.sum("bytes") / shards).alias("fair"))
    parts = F.when(F.col("bytes") > F.col("fair") / 2, F.ceil(8 * F.col("bytes") / F.col("fair"))).otherwise(1)
    # one row against at most `slots` rows: both sides are of fixed size
    cut = whole.join(F.broadcast(fair), F.lit(True)).select("vslot", parts.cast("int").alias("parts"))
    dealt = rows.join(F.broadcast(cut), "vslot").groupBy("vslot", _part(F.col("parts")).alias("part")).agg(
        F.sum("size").alias("bytes"))
    places = cut.select("vslot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "parts")
    return places.join(dealt, ["vslot", "part"], "left").select(
        "vslot", "part", "parts", F.coalesce("bytes", F.lit(0)).alias("bytes"))


def _give(state: Column, item: Column) -> Column:
    """The fold's step: an item goes to the least loaded shard, an empty one to
    the shard that holds the fewest empty ones."""
    least = F.when(item["bytes"] > 0, F.array_position(state["load"], F.array_min(state["load"]))).otherwise(
        F.array_position(state["empty"], F.array_min(state["empty"]))).cast("int") - 1
    load = F.transform(state["load"], lambda v, i: F.when(i == least, v + item["bytes"]).otherwise(v))
    empty = F.transform(state["empty"], lambda v, i: F.when((i == least) & (item["bytes"] == 0), v + 1).otherwise(v))
    return F.struct(load.alias("load"), empty.alias("empty"), F.array_append(state["shard"], least).alias("shard"))


def first_map(slots_: DataFrame, shards: int) -> DataFrame:
    """Version 0 of the map: largest slot first to the least loaded shard.

    The fold runs over one array of at most ``slots`` entries and the parts of
    split slots (at most eight a shard)."""
    items = slots_.agg(_by_size(F.collect_list(F.struct("bytes", "vslot", "part", "parts"))).alias("items"))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("load"),
                     F.array_repeat(F.lit(0).cast("long"), shards).alias("empty"),
                     F.array().cast("array<int>").alias("shard"))
    dealt = items.select("items", F.aggregate("items", start, _give)["shard"].alias("shard"))
    return (dealt.select(F.explode(F.arrays_zip("items", "shard")).alias("x"))
            .select(F.lit(0).alias("version"), "x.items.vslot", "x.items.part", "x.items.parts", "x.items.bytes",
                    "x.shard"))


def rebalance(previous: DataFrame, shards: int) -> DataFrame:
    """The next version of a map for ``shards`` shards (more than before, or
    the same number after slots have grown: update ``bytes`` first).

    Slots leave a shard only as far as it is above its fair share, smallest
    first, or if the shard no longer exists; they go to the least loaded.
    Empty slots are shared out by their number instead."""
    empty = (F.col("bytes") == 0).cast("long")
    fair = previous.agg((F.sum("bytes") / shards).alias("fair"), F.ceil(F.sum(empty) / shards).alias("fair_empty"))
    order = Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot", "part")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    held = (previous.withColumn("upto", F.sum("bytes").over(upto)).withColumn("upto_empty", F.sum(empty).over(upto))
            .join(F.broadcast(fair), F.lit(True)))
    fits = F.when(F.col("bytes") > 0, F.col("upto") <= F.col("fair")).otherwise(
        F.col("upto_empty") <= F.col("fair_empty"))
    marked = held.withColumn("stays", (F.col("shard") < shards) & fits)
    load = marked.where("stays").groupBy("shard").agg(F.sum("bytes").alias("load"), F.sum(empty).alias("empty"))
    loads = (previous.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
             .join(load, "shard", "left")
             .agg(F.array_sort(F.collect_list(F.struct("shard", F.coalesce("load", F.lit(0)).alias("load"),
                                                       F.coalesce("empty", F.lit(0)).alias("empty")))).alias("l"))
             .select(F.transform("l", lambda x: x["load"].cast("long")).alias("load"),
                     F.transform("l", lambda x: x["empty"].cast("long")).alias("empty")))
    moving = marked.where("not stays").agg(
        _by_size(F.collect_list(F.struct("bytes", "vslot", "part", "parts"))).alias("items"))
    dealt = (moving.join(F.broadcast(loads), F.lit(True))
             .select("items", F.aggregate("items", F.struct("load", "empty", F.array().cast("array<int>").alias("shard")),
                                          _give)["shard"].alias("shard"))
             .select(F.explode(F.arrays_zip("items", "shard")).alias("x"))
             .select("x.items.vslot", "x.items.part", "x.items.parts", "x.items.bytes", "x.shard"))
    version = previous.agg((F.max("version") + 1).alias("version"))
    return (marked.where("stays").select("vslot", "part", "parts", "bytes", "shard").unionByName(dealt)
            .join(F.broadcast(version), F.lit(True)).select("version", "vslot", "part", "parts", "bytes", "shard"))


def store_map(slot_map: DataFrame, path: str) -> None:
    """Add a version to the stored maps."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version, the latest if none is named."""
    maps = spark.read.schema(_MAP).parquet(path)
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    return maps.where(F.col("version") == version)


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS,
          slot_map: DataFrame | None = None, places: int = 512, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, size, text_crc32, vslot, part, shard, slot for every row.

    ``slot`` is the row's place in its shard, gapless from 0: rows are
    numbered within ``places`` hash buckets of each shard, and the buckets'
    counts give the numbers to start from.  ``slot_map``: a stored map of
    ``slots`` slots; else one is made from the rows."""
    scratch = scratch or Scratch(docs.sparkSession, "sharding")
    rows = scratch.table(sized(docs, id_col, text_col, slots), "sized")
    if slot_map is None:
        slot_map = first_map(slot_bytes(rows, shards, slots), shards)
    slot_map = scratch.table(slot_map, "map")
    parts = slot_map.groupBy("vslot").agg(F.first("parts").alias("parts"))
    # the map is of fixed size: `slots` rows and at most eight parts a shard
    lost = F.raise_error(F.concat(F.lit("no shard in the slot map for vslot "), F.col("vslot").cast("string")))
    placed = (rows.join(F.broadcast(parts), "vslot", "left").withColumn("part", _part(F.col("parts")))
              .join(F.broadcast(slot_map.select("vslot", "part", "shard")), ["vslot", "part"], "left")
              .withColumn("shard", F.coalesce("shard", lost.cast("int")))
              .withColumn("bucket", F.pmod(F.xxhash64("spread", F.lit(2)), F.lit(places)).cast("int")))
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    own = Window.partitionBy("shard", "bucket").orderBy("doc_id", "spread")
    return (placed.withColumn("nth", F.row_number().over(own) - 1)
            .join(F.broadcast(begins), ["shard", "bucket"])  # shards * places rows
            .select("doc_id", "size", "text_crc32", "vslot", "part", "shard",
                    (F.col("begin") + F.col("nth")).cast("long").alias("slot")))
