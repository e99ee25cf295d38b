"""As-of lookups without theta joins.

* ``anchor``: newest row in a trailing date band, as a conditional aggregate.
* ``window_end``: first row a fixed number of days ahead, as a RANGE frame.
* ``next_price``: first price on or after any target date, carried back over the
  days asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from navloom import constants as K
from navloom.operators import series
from navloom.session import settle


def anchor(value: Column, date: Column, latest: Column, days: int) -> Column:
    """Aggregate: ``value`` of the newest row with
    latest - days - tolerance < date <= latest - days, else null."""
    target = F.date_sub(latest, days)
    inside = (date <= target) & (date > F.date_sub(target, K.ANCHOR_TOLERANCE_DAYS))
    return F.max_by(F.when(inside, value), F.when(inside, date))


def window_end(columns: list[str], days: int, day: str | None = None) -> Column:
    """Struct of the first row ``days`` or up to a week more ahead, else null; ``day`` is a column with the day's number."""
    frame = series.by_day_number(day).rangeBetween(days, days + K.WINDOW_END_TOLERANCE_DAYS)
    return F.first(F.struct(*columns)).over(frame)


def next_price(targets: DataFrame, nav: DataFrame, target: str) -> DataFrame:
    """Adds price_date and price: the first price on or after ``target``. The
    targets carry their scheme's ``first_date``; a target past the latest price
    has no match and is dropped. Only the distinct (scheme, day) asked for meet the
    prices of their schemes, one row per scheme and day, and each takes the price
    that follows; the answers then join the targets like any table."""
    probe = targets.withColumn("day", F.greatest(F.col(target), F.col("first_date")))
    asked = settle(probe.select("scheme_code", "day").distinct(), "asked-days")
    priced = nav.join(asked.select("scheme_code").distinct(), "scheme_code", "left_semi")
    days = (asked.select("scheme_code", "day", F.lit(None).cast("date").alias("price_date"), F.lit(None).cast("double").alias("price"), F.lit(1).alias("asked"))
            .unionByName(priced.select("scheme_code", F.col("date").alias("day"), F.col("date").alias("price_date"), F.col("nav").alias("price"), F.lit(0).alias("asked")))
            .groupBy("scheme_code", "day").agg(F.max("price_date").alias("price_date"), F.max("price").alias("price"), F.max("asked").alias("asked")))
    newest_first = Window.partitionBy("scheme_code").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    following = F.last(F.when(F.col("price_date").isNotNull(), F.struct("price_date", "price")), ignorenulls=True).over(newest_first)
    answers = days.select("scheme_code", "day", "asked", following.alias("next")).filter((F.col("asked") == 1) & F.col("next").isNotNull())
    return probe.join(answers.select("scheme_code", "day", "next.price_date", "next.price"), ["scheme_code", "day"]).drop("day")
