"""Scheme-level data-quality flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navloom import constants as K
from navloom.operators import series


def quality_flags(master: DataFrame, nav: DataFrame, as_of: str) -> DataFrame:
    """(scheme_code, data_quality): 'stale' when the newest price is missing or
    older than 45 days, else 'discontinuity' when a jump lies inside the last
    year, else null. Both answers need the last year of prices only, so the scan
    is cut to it; a step into the slice from before it is not looked at."""
    day = F.lit(as_of).cast("date")
    recent = nav.filter(F.col("date") >= F.date_sub(day, K.JUMP_LOOKBACK_DAYS))
    change = F.try_divide(F.col("nav"), F.lag("nav").over(series.by_date())) - 1
    facts = (recent.withColumn("jump", F.coalesce(F.abs(change) > K.JUMP_LIMIT, F.lit(False)))
                   .groupBy("scheme_code").agg(F.max("date").alias("latest"), F.max("jump").alias("jumped")))
    fresh = F.coalesce(F.col("latest") >= F.date_sub(day, K.STALE_AFTER_DAYS), F.lit(False))
    return (master.select("scheme_code").join(facts, "scheme_code", "left")
                  .select("scheme_code", F.when(~fresh, "stale").when(F.col("jumped"), "discontinuity").alias("data_quality")))


def quality_note(flag: Column, latest: Column) -> tuple[Column, Column]:
    """Label and explanation shown for a flagged scheme; null for a healthy one."""
    label = F.when(flag == "stale", "no recent price").when(flag == "discontinuity", "broken price series")
    text = (F.when(flag == "stale", F.concat(F.lit("Last priced: "), F.coalesce(latest.cast("string"), F.lit("unknown")), F.lit(". Not listed, not ranked.")))
             .when(flag == "discontinuity", "One day moves by more than 40%. Figures over spans with that day are null."))
    return label, text


def with_quality(master: DataFrame, flags: DataFrame) -> DataFrame:
    """The master table with freshly computed flags."""
    return master.drop("data_quality").join(flags, "scheme_code", "left")


def usable(master: DataFrame) -> DataFrame:
    return master.filter(F.col("is_active") & F.col("data_quality").isNull())
