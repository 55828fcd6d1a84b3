"""A table bucketed by a key that grows by batches, and its ledger.

Rows are a Spark bucketed table (one hash partitioning for all batches, so a
join or aggregation on the key needs no exchange on this side), partitioned by
the name of the batch that wrote them.  A batch counts once the ledger lists
it, and the entry is made after its rows: a batch that was lost between the two
is written again over the same partition, and a batch that is listed is never
run again, without a look at the rows."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.session import path_exists


class BucketedStore:
    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = 32):
        """``schema``: the columns as DDL, without ``batch``.  The same path has
        to be opened with the same schema, key and number of buckets."""
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self.table = "tidewire_store_" + hashlib.md5(path.encode()).hexdigest()[:16]
        known = path_exists(spark, f"{path}/rows")
        if not spark.catalog.tableExists(self.table):
            spark.sql(f"CREATE TABLE {self.table} ({schema}, batch STRING) USING parquet PARTITIONED BY (batch) "
                      f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}/rows'")
            if known:  # made in another session
                spark.sql(f"ALTER TABLE {self.table} RECOVER PARTITIONS")
        self.columns = [c for c in spark.table(self.table).columns if c != "batch"]

    def _files(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _list(self, name: str, replaces: list[str]) -> None:
        files, path = self._files(f"ledger/{name}")
        out = files.create(path, True)
        out.write(bytearray(json.dumps(replaces).encode()))
        out.close()

    def batches(self) -> list[str]:
        """All batches ever committed."""
        files, path = self._files("ledger")
        return sorted(f.getPath().getName() for f in files.listStatus(path)) if files.exists(path) else []

    def has(self, batch: str) -> bool:
        files, path = self._files(f"ledger/{batch}")
        return bool(files.exists(path))

    def _live(self) -> list[str]:
        """The batches that hold the rows: the last compaction and what came after it."""
        every = self.batches()
        bases = [b for b in every if b.startswith("base-")]
        if not bases:
            return every
        gone = {*self.spark.read.text(f"{self.path}/ledger/{bases[-1]}").select(
            F.explode(F.from_json("value", "array<string>"))).toPandas().iloc[:, 0], *bases[:-1]}
        return [b for b in every if b not in gone]

    def rows(self) -> DataFrame:
        """The rows of committed batches."""
        return self.spark.table(self.table).where(F.col("batch").isin(self._live())).drop("batch")

    def _write(self, batch: str, rows: DataFrame) -> None:
        """Write a batch's partition, one file a bucket; what a lost run left there goes."""
        view = f"{self.table}_in"
        rows.select(*self.columns).repartition(self.buckets, self.key).createOrReplaceTempView(view)
        files, path = self._files(f"rows/batch={batch}")
        files.delete(path, True)
        rows.sparkSession.sql(f"INSERT INTO {self.table} PARTITION (batch = '{batch}') "
                              f"SELECT {', '.join(f'`{c}`' for c in self.columns)} FROM {view}")

    def commit(self, batch: str, rows: DataFrame) -> None:
        """Add a batch's rows; nothing if it is committed already."""
        if not self.has(batch):
            self._write(batch, rows)
            self._list(batch, [])

    def compact(self) -> None:
        """One partition in place of all batches so far.  What it replaces is
        no longer read; its files can go once no reader uses them."""
        every = self.batches()
        base = f"base-{sum(b.startswith('base-') for b in every):09d}"
        self._write(base, self.rows())
        self._list(base, [b for b in every if not b.startswith("base-")])
