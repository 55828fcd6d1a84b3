"""Exact deduplication by content sort.

Rows are range-partitioned by sampled splitters on (the first 64 characters,
a 64-bit hash of the text, the preferred identifier first), sorted externally
within partitions with the whole text in the key, and compared with their
neighbour in full.  The sampled key is short whatever the texts' length, and
because the identifier is its last part, a group of copies that holds a third
of all rows is cut over many partitions.  Runs of equal texts that touch a
partition's first or last key are joined across partitions by their whole text
(a few rows per partition); all other runs are complete within theirs.

Defined results: a null text counts as empty; rows with null identifiers
compare as the last choice and are otherwise ordinary; a repeated (identifier,
text) row is a copy like any other and exactly one row of a group is kept;
an empty table gives no rows; further columns are not read.  Texts are never
cut.  Memory: one Arrow batch and the texts of a partition's edge runs."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import Scratch, map_arrow

_PREFIX = 64
_RUN_SCHEMA = ("doc_id bigint, text_sha256 string, part long, run long, place long, "
               "edge_text binary, edge_rows long")


def _runs(batches):
    """Number the runs of equal neighbours of one sorted partition."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_sha256", pa.string()), ("part", pa.int64()),
                        ("run", pa.int64()), ("place", pa.int64()), ("edge_text", pa.binary()),
                        ("edge_rows", pa.int64())])
    part = run = place = -1
    last_text = last_sha = first_key = last_key = None
    first_runs: dict[int, list] = {}
    last_runs: dict[int, list] = {}

    def edge(entries):
        n = len(entries)
        return pa.record_batch([
            pa.array([e[2] for e in entries], pa.int64()), pa.nulls(n, pa.string()),
            pa.array([part] * n, pa.int64()), pa.array([e[0] for e in entries], pa.int64()),
            pa.array([-1] * n, pa.int64()), pa.array([e[1] for e in entries], pa.binary()),
            pa.array([e[3] for e in entries], pa.int64())], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column("part")[0].as_py()
        text, ids = batch.column("bytes"), batch.column("doc_id")
        keys = batch.column("text_hash").to_pylist()
        n = batch.num_rows
        same = np.zeros(n, bool)
        same[1:] = pc.equal(text.slice(1), text.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        same[0] = last_text is not None and text[0].as_py() == last_text
        run_of, places, shas = np.empty(n, np.int64), np.empty(n, np.int64), []
        for i in range(n):
            if same[i]:
                place += 1
            else:
                run, place = run + 1, 0
                value = text[i].as_py()
                last_sha = hashlib.sha256(value).hexdigest()
                if first_key is None:
                    first_key = keys[i]
                if keys[i] != last_key:
                    last_key, last_runs = keys[i], {}
                entry = [run, value, ids[i].as_py(), 0]
                last_runs[run] = entry
                if keys[i] == first_key:
                    first_runs[run] = entry
            last_runs[run][3] += 1
            run_of[i], places[i] = run, place
            shas.append(last_sha)
        last_text = text[n - 1].as_py()
        yield pa.record_batch([ids, pa.array(shas, pa.string()), pa.array([part] * n, pa.int64()),
                               pa.array(run_of), pa.array(places), pa.nulls(n, pa.binary()),
                               pa.nulls(n, pa.int64())], schema=schema)
    edges = list({**first_runs, **last_runs}.values())
    for i in range(0, len(edges), 64):
        yield edge(edges[i:i + 64])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                keep: str = "smallest", scratch: Scratch | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep``: ``smallest`` or ``largest`` identifier of each group of equal
    texts stays."""
    scratch = scratch or Scratch(docs.sparkSession, "exact-dedup")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.cast("binary").alias("bytes"),
                       F.substring(text, 1, _PREFIX).alias("prefix"), F.xxhash64(text).alias("text_hash"))
    order = F.col("doc_id").asc_nulls_last() if keep == "smallest" else F.col("doc_id").desc_nulls_last()
    rows = (rows.repartitionByRange(F.col("prefix"), F.col("text_hash"), order)
            .sortWithinPartitions(F.col("prefix"), F.col("text_hash"), F.col("bytes"), order)
            .select("doc_id", "bytes", "text_hash", F.spark_partition_id().cast("long").alias("part")))
    runs = scratch.table(map_arrow(rows, _runs, _RUN_SCHEMA), "runs")
    members, edges = runs.where("place >= 0"), runs.where("place < 0")
    best = F.min("doc_id") if keep == "smallest" else F.max("doc_id")
    # a run that touches an edge belongs to the whole group of its text
    groups = edges.groupBy("edge_text").agg(
        best.alias("edge_keep"), F.sum("edge_rows").alias("edge_size"),
        F.min("part").alias("edge_part"))
    edge_runs = (edges.select("part", "run", "edge_text").join(groups, "edge_text")
                 .select("part", "run", "edge_keep", "edge_size", "edge_part"))
    sizes = members.groupBy("part", "run").agg(
        F.count(F.lit(1)).alias("rows"), best.alias("head"))
    sizes = (sizes.join(edge_runs, ["part", "run"], "left")
             .select("part", "run", F.coalesce("edge_size", "rows").alias("group_size"),
                     F.when(F.col("edge_size").isNull(), F.col("head")).otherwise(F.col("edge_keep")).alias("keep_id"),
                     F.coalesce("edge_part", "part").alias("keep_part")))
    return (members.join(sizes, ["part", "run"])
            .select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
                    ((F.col("part") == F.col("keep_part")) & (F.col("place") == 0)).alias("kept"),
                    "text_sha256"))
