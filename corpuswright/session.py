"""Session settings, the shared scratch folder and materialisation."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings the operators count on; a cluster may override any of them.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Rows of long texts that a Python worker gets at once.
ARROW_ROWS = 1000


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """Local session for tests and benchmarks; clusters bring their own."""
    builder = SparkSession.builder.master(master).appName("corpuswright")
    settings = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        **extra,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only a session that names none, as in tests, gets a folder of its own.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="corpuswright-"))
        current = spark.sparkContext.getCheckpointDir()
    return named or current


def scratch_path(spark: SparkSession, label: str) -> str:
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage, survives lost executors, and (unlike a row checkpoint) later
    branches still prune columns. Every branch sees the same rows, so values
    tied to partition numbers stay consistent.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Fewer rows of long texts in an Arrow batch, which JVM and worker hold at once; a cluster's own setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not spark.sparkContext.getConf().contains(key):
        spark.conf.set(key, ARROW_ROWS)


def bucketed(df: DataFrame, key: str, label: str = "buckets") -> DataFrame:
    """Write ``df`` once into hash buckets of ``key``; joins on ``key`` then leave it where it lies.

    The table is external, so its files are in the shared folder as all others.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"{label}_{uuid.uuid4().hex}"
    # dealt out first, so that a bucket is one file
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", scratch_path(spark, label)).saveAsTable(name)
    return spark.table(name)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give CPU-heavy work every core when the input is a few files.

    A file is often one row group, which is one task however many byte splits it
    has. Inputs of many files or many splits, the normal case at scale, are left
    alone, so no shuffle is added there.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    if splits >= 4 * cores or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(max(cores, splits), key)
