"""Windows over daily price series.

A price table has one row per (scheme, day), which ``sources.prices`` enforces
with a partial aggregate before anything here runs. A window partition is
therefore bounded by the calendar, however many raw rows one scheme has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from navloom import constants as K



def by_date():
    return Window.partitionBy("scheme_code").orderBy("date")


def by_day_number(day: str | None = None):
    """Same order as an INT key, so that RANGE frames count days. With the key in a column ``day``, all windows over it
    share one sort."""
    return Window.partitionBy("scheme_code").orderBy(day or F.unix_date("date"))


def with_jumps(nav: DataFrame) -> DataFrame:
    """Adds ``jumps``: how many non-economic steps happened up to this day. Two
    days have a clean span between them iff their counts are equal."""
    w = by_date()
    change = F.try_divide(F.col("nav"), F.lag("nav").over(w)) - 1
    stepped = nav.withColumn("is_jump", F.when(F.abs(change) > K.JUMP_LIMIT, 1).otherwise(0))
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return stepped.withColumn("jumps", F.sum("is_jump").over(upto)).drop("is_jump")


def price_bounds(nav: DataFrame) -> DataFrame:
    """First and latest price of every scheme."""
    return nav.groupBy("scheme_code").agg(
        F.min("date").alias("first_date"), F.min_by("nav", "date").alias("first_nav"),
        F.max("date").alias("latest_date"), F.max_by("nav", "date").alias("latest_nav"))


def latest_by(df: DataFrame, key: str, order: str, **columns: str) -> DataFrame:
    """One row per key holding ``columns`` (new name -> source) of its newest row."""
    return df.groupBy(key).agg(*(F.max_by(src, order).alias(new) for new, src in columns.items()))
