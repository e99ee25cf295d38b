"""Point-to-point returns for every scheme and period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from navloom import constants as K
from navloom.functions.rounding import rnd
from navloom.operators import asof, series

DAYS_PER_YEAR = 365


def scheme_returns(nav: DataFrame) -> DataFrame:
    """(scheme_code, period, ret, as_of_date). The anchor is the newest price in
    the two weeks up to the period's start; no row where it is missing, not
    positive, or separated from the latest price by a jump. Periods of three
    nominal years and more are annualised. One shuffle, on scheme_code."""
    rows = series.with_jumps(nav).withColumn("latest", F.max("date").over(Window.partitionBy("scheme_code")))
    latest, date = F.col("latest"), F.col("date")
    # plain columns, not structs, so that the aggregate stays a hash aggregate
    wide = rows.groupBy("scheme_code").agg(
        F.max("date").alias("as_of_date"), F.max_by("nav", "date").alias("nav"), F.max_by("jumps", "date").alias("jumps"),
        *(asof.anchor(F.col(c), date, latest, days).alias(f"{c}{p}") for p, days in K.PERIOD_DAYS.items() for c in ("nav", "jumps")))
    periods = F.explode(F.array(*(
        F.struct(F.lit(p).alias("period"), F.lit(float(days // DAYS_PER_YEAR)).alias("years"),
                 F.col(f"nav{p}").alias("anchor"), F.col(f"jumps{p}").alias("anchor_jumps"))
        for p, days in K.PERIOD_DAYS.items())))
    flat = wide.select("scheme_code", "as_of_date", "nav", "jumps", periods.alias("p")).select(
        "scheme_code", "as_of_date", "nav", "jumps", "p.*")
    return from_anchors(flat)


def from_anchors(flat: DataFrame) -> DataFrame:
    """scheme_returns from rows of (scheme_code, as_of_date, nav, jumps, period, years, anchor, anchor_jumps)."""
    anchor = F.nullif(F.col("anchor"), F.lit(0.0))
    ret = (F.when(F.col("years") >= 3, F.power(F.col("nav") / anchor, 1 / F.greatest(F.col("years"), F.lit(1.0))) - 1)
            .otherwise((F.col("nav") - anchor) / anchor))
    return (flat.filter((F.col("anchor") > 0) & (F.col("anchor_jumps") == F.col("jumps")))
                .select("scheme_code", "period", rnd(ret * 100, 2).alias("ret"), "as_of_date"))


def period_position(period: Column) -> Column:
    """Sort key that puts periods in business order."""
    return F.array_position(F.array(*map(F.lit, K.PERIOD_DAYS)), period)
