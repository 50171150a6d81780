"""Session helpers: a tuned local/cluster session and reliable checkpoints."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "tmaps") -> SparkSession:
    """Session with AQE (coalescing + skew join) on and the web UI off."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    cores = os.cpu_count() or 8
    b = (b.config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.driver.memory", "16g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; only when it is unset
    (local tests) create a private scratch folder."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tmaps-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application: Python workers
    import its kernels by name, and a cluster's nodes need not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    root, name = os.path.split(package)
    folder = tempfile.mkdtemp(prefix=f"{name}-zip-")  # the driver's own; Spark serves the file to executors
    sc.addPyFile(shutil.make_archive(os.path.join(folder, name), "zip", root, name))
    _SHIPPED.add(sc.applicationId)


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss); never a local one."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_by(df: DataFrame, parts: int, *keys: str, ordered: tuple[str, ...] = ()) -> DataFrame:
    """Reliable checkpoint, hash-partitioned by ``keys`` (and sorted), that later plans know to be
    so: they add no exchange on that side. An adaptive plan does not hand its partitioning on, so
    this one repartitioning is planned without; what leads to ``df`` should be written already."""
    conf = df.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        placed = df.repartition(parts, *keys)
        return checkpoint(placed.sortWithinPartitions(*ordered) if ordered else placed)
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    import uuid
    return f"{base.rstrip('/')}/tables/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write a table below the shared checkpoint folder and read it again: a short
    plan whose rows are the same however often they are read."""
    path = path or scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, path: str):
    """Hadoop's file system and path objects: the folder may be on any shared storage."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def committed(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """Numbers k, ascending, of the tables ``<folder>/<prefix><k>`` that were written to the end."""
    fs, at = _files(spark, folder)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    numbers = sorted(int(x[len(prefix):]) for x in names if x.startswith(prefix) and x[len(prefix):].isdigit())
    return [k for k in numbers if fs.exists(_files(spark, f"{folder}/{prefix}{k}/_SUCCESS")[1])]


def drop_table(spark: SparkSession, path: str) -> None:
    """Removes a table that this library wrote."""
    fs, at = _files(spark, path)
    fs.delete(at, True)
