"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

# Skewed join keys are split at run time and small partitions coalesced; the
# partition advice keeps a shuffled partition well inside executor memory.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
}


_TABLES = "navloom_scratch_"
_OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName("navloom")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _scratch_root(spark: SparkSession) -> str:
    """One folder per application under ``spark.checkpoint.dir``. Where that is unset it is the warehouse, unless that is a
    folder of one machine and the executors are on others."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir")
        scheme = file_system(spark, root)[0].getUri().getScheme()
        if scheme == "file" and not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors share; {root} is on one machine")
    return f"{root.rstrip('/')}/navloom-{spark.sparkContext.applicationId}"


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder name in the application's scratch folder."""
    return f"{_scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def scratch_table(spark: SparkSession, label: str) -> str:
    """A new name for a catalog table that ``clear_scratch`` drops."""
    return f"{_TABLES}{label.replace('-', '_')}_{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it wants it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def clear_scratch(spark: SparkSession) -> None:
    """Drops the scratch tables and the scratch folder of this application. Results
    that were not written elsewhere can no longer be read afterwards."""
    for table in spark.catalog.listTables():
        if table.name.startswith(_TABLES):
            spark.sql(f"DROP TABLE IF EXISTS {table.name}")
    system, root = file_system(spark, _scratch_root(spark))
    system.delete(root, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def settle(df: DataFrame, label: str) -> DataFrame:
    """Writes an intermediate result that several stages read to the shared scratch
    folder and reads it back. It is computed once, column pruning starts from
    files, and losing an executor repeats tasks, not the lineage behind it."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle_by(df: DataFrame, label: str, *keys: str, buckets: int | None = None, placed: bool = False) -> DataFrame:
    """``settle`` with equal ``keys`` in one file: a scratch table of as many buckets as a shuffle has partitions, or of ``buckets``. Joins
    and aggregates over these keys read it where it lies, so rows that meet there several times are shuffled once. Rows that are
    ``placed`` lie by the keys already, and are written as they come: neither shuffled again nor sorted by bucket."""
    spark = df.sparkSession
    name, buckets = scratch_table(spark, label), buckets or shuffle_partitions(spark)
    rows = df if placed else df.repartition(*keys)
    before = spark.conf.get(_OPEN_FILES)
    if placed:
        spark.conf.set(_OPEN_FILES, "8")
    try:
        rows.write.format("parquet").bucketBy(buckets, *keys).option("path", scratch_dir(spark, label)).saveAsTable(name)
    finally:
        spark.conf.set(_OPEN_FILES, before)
    return spark.table(name)
