"""Session construction and lineage-cutting support."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# Reference instant of every fixture run ("no hidden clock"): operators take
# ``as_of`` explicitly; this is the default used by the registered queries.
AS_OF = "2024-01-31 00:00:00"


def get_spark(app: str = "tidewire", cpus: int | str | None = None,
              shuffle_partitions: int | None = None) -> SparkSession:
    """Local session with the settings the engine is designed around.

    On a cluster the session comes from the launcher; only the SQL settings
    below matter there (AQE + skew join are what keep hot keys in check).
    """
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    parts = shuffle_partitions or int(cpus) * 2
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("TIDEWIRE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # HTML pages can be large: keep the Arrow batches of the one
        # mapInPandas step (main-text extraction) small in memory
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
        .config("spark.sql.files.maxPartitionBytes", str(64 * 1024 * 1024))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, honouring ``spark.checkpoint.dir``.

    The cluster names a shared folder in ``spark.checkpoint.dir``; it is used
    as is.  Only when nothing is configured *and* the master is local (tests,
    benches) a private scratch folder is created.  On a cluster without the
    setting we refuse rather than write to a machine-local folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: iterative operators need a shared "
            "folder to cut lineage on a cluster")
    scratch = tempfile.mkdtemp(prefix="tidewire-ckpt-")
    sc.setCheckpointDir(scratch)
    return sc.getCheckpointDir() or scratch


def materialize(df, name: str = "stage"):
    """Cut lineage by writing ``df`` as a parquet table into the shared
    checkpoint folder and reading it back.

    One job computes the rows once (``Dataset.checkpoint`` computes an
    unpersisted plan twice: once for its count, once to write the files),
    the table is columnar and compressed, and readers get column pruning and
    filter pushdown on it.  Survives executor loss: the files are on shared
    storage."""
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark)
    path = os.path.join(root, "tables", f"{name}-{uuid.uuid4().hex[:16]}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check on the path's own file system (HDFS, object stores,
    local) through the session's Hadoop configuration."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per Spark context, so that
    functions running in their Python workers can import it wherever the
    driver was started from."""
    sc = spark.sparkContext
    if getattr(sc, "_tidewire_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="tidewire-ship-"), "tidewire")
    sc.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(here), os.path.basename(here)))
    sc._tidewire_shipped = True
