"""Exact order positions inside groups of any size.

A plain window would sort a whole group in one task. Here equal values are
counted first (map-side), the counts are summed per unit-wide bucket, and a
value's position is the count of the buckets below plus the count inside its
own bucket. With values rounded to two places a bucket holds at most 100
distinct values, and the bucket window sees buckets, not rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_positions(rows: DataFrame, keys: list[str], value: str, *extra: Column) -> DataFrame:
    """One row per (keys, value): ``n`` rows share the value, ``below`` rows are
    smaller, ``total`` rows are in the group; ``extra`` aggregates ride along."""
    counted = (rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), *extra)
                   .withColumn("bucket", F.floor(value)))
    group = Window.partitionBy(*keys)
    lower = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (counted.groupBy(*keys, "bucket").agg(F.sum("n").alias("in_bucket"))
                      .withColumn("below_bucket", F.coalesce(F.sum("in_bucket").over(lower), F.lit(0)))
                      .withColumn("total", F.sum("in_bucket").over(group))
                      .drop("in_bucket"))
    inner = Window.partitionBy(*keys, "bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (counted.join(buckets, [*keys, "bucket"])
                   .withColumn("below", F.col("below_bucket") + F.coalesce(F.sum("n").over(inner), F.lit(0)))
                   .drop("bucket", "below_bucket"))


def median_of(value: str) -> Column:
    """Aggregate over ``value_positions`` rows of one group: the interpolated
    median, from the values that cover the two middle positions."""
    low = F.floor((F.col("total") - 1) / 2)
    high = F.ceil((F.col("total") - 1) / 2)

    def at(position: Column) -> Column:
        covers = (F.col("below") <= position) & (position < F.col("below") + F.col("n"))
        return F.max(F.when(covers, F.col(value)))

    return (at(low) + at(high)) / 2


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The k first rows of each group. Spark cuts every map partition to k rows
    per group before the shuffle, so a hot group stays small."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
