"""What a Regular plan's commission cost against its Direct twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navloom import constants as K
from navloom.functions.rounding import rnd
from navloom.operators import series


def plan_twins(master: DataFrame) -> DataFrame:
    """One row per fund group and option with its Direct and Regular codes."""
    plans = master.filter(F.col("fund_group_id").isNotNull() & F.col("option_type").isNotNull()
                          & F.col("plan_type").isin("Direct", "Regular"))
    return plans.groupBy("fund_group_id", "option_type").agg(
        F.min(F.when(F.col("plan_type") == "Direct", F.col("scheme_code"))).alias("direct_code"),
        F.min(F.when(F.col("plan_type") == "Regular", F.col("scheme_code"))).alias("regular_code"))


def unlinked_plans(master: DataFrame) -> DataFrame:
    """Direct and Regular plans that belong to no fund group: nothing to compare them with."""
    plans = master.filter(F.col("fund_group_id").isNull() & F.col("plan_type").isin("Direct", "Regular"))
    return plans.select("scheme_code", "plan_type", "option_type", F.lit("not linked to a fund group").alias("reason"))


def cost_leak(master: DataFrame, nav: DataFrame, costs: DataFrame, amount: float = 500_000.0,
              years: float | None = None) -> DataFrame:
    """The same amount put into both plans on the same day, valued at the end of
    their shared history (cut to the last ``years`` when given). Not comparable,
    with the reason, without a twin or a shared year. Both plans of a pair are
    valued in one conditional aggregate over their own prices."""
    twins = plan_twins(master)
    sides = twins.select("fund_group_id", "option_type", F.explode(F.array(
        F.struct(F.lit("direct").alias("side"), F.col("direct_code").alias("scheme_code")),
        F.struct(F.lit("regular").alias("side"), F.col("regular_code").alias("scheme_code")))).alias("s")
    ).select("fund_group_id", "option_type", "s.*").filter(F.col("scheme_code").isNotNull())
    pair = ["fund_group_id", "option_type"]

    spans = (sides.join(series.price_bounds(nav), "scheme_code").groupBy(*pair).agg(
        F.count(F.lit(1)).alias("priced"), F.max("first_date").alias("start"), F.min("latest_date").alias("end")))
    if years is not None:
        spans = spans.withColumn("start", F.greatest("start", F.date_sub("end", round(years * 365))))
    spans = spans.filter((F.col("priced") == 2) & (F.datediff("end", "start") >= K.MIN_SHARED_DAYS))

    def of(side: str, value: Column) -> Column:
        return F.max(F.when(F.col("side") == side, value))

    # plain columns per scheme first, then per pair: all of it hash aggregates
    priced = sides.join(spans, pair).join(nav, "scheme_code").groupBy(*pair, "side", "start", "end").agg(
        F.min_by("nav", F.when(F.col("date") >= F.col("start"), F.col("date"))).alias("buy_nav"),
        F.min(F.when(F.col("date") >= F.col("start"), F.col("date"))).alias("bought"),
        F.coalesce(F.min_by("nav", F.when(F.col("date") >= F.col("end"), F.col("date"))), F.max_by("nav", "date")).alias("sell_nav"))
    valued = (priced.withColumn("value", F.when(F.col("buy_nav") > 0, amount / F.nullif(F.col("buy_nav"), F.lit(0.0)) * F.col("sell_nav")))
              .groupBy(*pair, "end").agg(of("direct", F.col("value")).alias("d"), of("regular", F.col("value")).alias("r"),
                                         of("direct", F.col("bought")).alias("buy_date"))
              .filter(F.col("d").isNotNull() & F.col("r").isNotNull()))

    days = F.datediff("end", "buy_date")
    span = F.when(days > 0, days / 365.0).when(days.isNotNull(), 1e-9)

    def cagr(value: str) -> Column:
        return (F.power(F.col(value) / amount, 1 / span) - 1) * 100

    ter = series.latest_by(costs, "scheme_code", "as_of_date", ter="ter")
    about = master.select("scheme_code", "name").join(ter, "scheme_code", "left")
    leak = F.col("d") - F.col("r")
    return (twins.join(valued, pair, "left")
            .join(about.select(*(F.col(c).alias(f"direct_{c.removeprefix('scheme_')}") for c in about.columns)), "direct_code", "left")
            .join(about.select(*(F.col(c).alias(f"regular_{c.removeprefix('scheme_')}") for c in about.columns)), "regular_code", "left")
            .select(*pair, "direct_code", "regular_code", "direct_name", "regular_name", rnd(F.col("direct_ter"), 2).alias("direct_ter"),
                    rnd(F.col("regular_ter"), 2).alias("regular_ter"), F.col("d").isNotNull().alias("comparable"),
                    F.when(F.col("direct_code").isNull() | F.col("regular_code").isNull(), "no matching Direct and Regular pair")
                     .when(F.col("d").isNull(), "not enough shared history").alias("reason"),
                    F.col("buy_date").alias("start"), "end", rnd(span, 2).alias("years"),
                    rnd(F.col("d"), 2).alias("direct_value"), rnd(F.col("r"), 2).alias("regular_value"),
                    rnd(cagr("d"), 2).alias("direct_cagr"), rnd(cagr("r"), 2).alias("regular_cagr"),
                    rnd(leak, 2).alias("leak_rupees"), rnd(leak / amount * 100, 2).alias("leak_pct_of_investment"),
                    rnd(cagr("d") - cagr("r"), 2).alias("drag_pct_per_year"),
                    F.when(F.col("d").isNotNull(), rnd(F.col("regular_ter") - F.col("direct_ter"), 2)).alias("ter_gap")))
