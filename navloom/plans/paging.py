"""Pages of a sorted listing from a stored order.

The rows are range-partitioned by the order once and each part's place in it is kept, so that a page, however late, reads
the parts that hold it instead of sorting every row again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from navloom.session import settle

PART_ROWS = 100_000


def write_order(rows: DataFrame, order: list[Column], path: str, part_rows: int = PART_ROWS) -> None:
    """Writes ``rows`` in parts of about ``part_rows`` neighbours in ``order``, and (part, n, before): how many rows a part has and
    how many stand before it. ``order`` must tell any two rows apart."""
    kept = settle(rows, "listing")
    parts = max(1, -(-kept.count() // part_rows))
    (kept.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
         .sortWithinPartitions("part", *order).write.partitionBy("part").parquet(f"{path}/rows"))
    kept.limit(0).write.parquet(f"{path}/columns")
    spark = rows.sparkSession
    counted = spark.read.schema("part INT").parquet(f"{path}/rows").groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    lower = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over parts, not rows
    counted.withColumn("before", F.coalesce(F.sum("n").over(lower), F.lit(0))).coalesce(1).write.parquet(f"{path}/parts")


def page(spark: SparkSession, path: str, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows; empty beyond the last row. Only the parts with its rows are read."""
    first = (number - 1) * size
    holding = (spark.read.parquet(f"{path}/parts").filter((F.col("before") < first + size) & (F.col("before") + F.col("n") > first))
                    .orderBy("part").collect())  # the parts of one page
    columns = spark.read.parquet(f"{path}/columns")
    if not holding:
        return columns
    rows = spark.read.schema(columns.schema).parquet(*(f"{path}/rows/part={p.part}" for p in holding))
    return rows.orderBy(*order).offset(first - holding[0].before).limit(size)
