"""Incremental, idempotent price ingest.

Each landed file is processed once; a batch that is run again after a failure
merges the same keys and changes nothing. The merge is keyed by scheme and day,
so late rows for any date are accepted and no watermark is needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from navloom.sources import nav_text, prices


def ingest_available(stream: DataFrame, store: str, checkpoint: str,
                     to_prices: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> StreamingQuery:
    """Merges everything that has landed into the price store, then stops."""
    def merge(batch: DataFrame, _: int) -> None:
        prices.merge_into_store(batch.sparkSession, store, to_prices(batch))

    return (stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
                  .foreachBatch(merge).start())


def stream_daily_files(spark: SparkSession, path: str) -> DataFrame:
    """Lines of landed daily price files, addressed as ``nav_text`` expects; a
    batch always holds whole files."""
    return spark.readStream.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").alias("line"))


def ingest_daily_files(spark: SparkSession, path: str, store: str, checkpoint: str) -> StreamingQuery:
    def to_prices(batch: DataFrame) -> DataFrame:
        lines = batch.withColumn("pos", F.monotonically_increasing_id())
        return prices.daily_rows(nav_text.parse_lines(lines))

    return ingest_available(stream_daily_files(spark, path), store, checkpoint, to_prices)
