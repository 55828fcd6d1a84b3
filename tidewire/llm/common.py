"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.session import ensure_checkpoint_dir, ship_package

#: ASCII white space between words: space and \x09-\x0D (fixed value).
WORD_SPLIT = "[\\x20\\x09-\\x0D]+"


class Scratch:
    """Tables in the shared checkpoint folder that cut lineage within one call.

    A table survives the loss of executors; ``drop`` removes all of them once
    the caller has written its own result."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark)}/llm/{name}-{uuid.uuid4().hex[:16]}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def release() -> None:
    """Give freed memory back: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` with this package shipped to the executors."""
    ship_package(df.sparkSession)

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 20):
    """Cut a batch into runs of rows holding about ``most_bytes`` of ``column``
    (at least one row each), so that work arrays stay small."""
    text = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def hex_sha256(col) -> F.Column:
    return F.sha2(F.coalesce(col, F.lit("")).cast("binary"), 256)
