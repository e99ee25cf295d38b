"""Instalment and lump-sum backtests over real prices.

A plan is (plan_id, scheme_code, amount, start_date, last_instalment, freq).
``last_instalment`` stops the buying; the value is always taken at the newest
price.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from navloom import constants as K
from navloom.functions.rounding import rnd
from navloom.operators import asof, series
from navloom.session import settle

_EPSILON_YEARS = 1e-9


def _bounded(plans: DataFrame, nav: DataFrame) -> DataFrame:
    return plans.join(series.price_bounds(nav), "scheme_code")


def _cagr_pct(growth: Column, days: Column) -> Column:
    return (F.power(growth, 1 / F.greatest(days / 365.0, F.lit(_EPSILON_YEARS))) - 1) * 100


def plan_validity(plans: DataFrame, master: DataFrame, nav: DataFrame) -> DataFrame:
    """(plan_id, is_valid, reason, fund_cagr_pct): the start must lie inside the
    fund's history; fund_cagr_pct is the fund's own growth over all of it."""
    known = master.select("scheme_code", F.lit(True).alias("known"))
    checked = plans.join(known, "scheme_code", "left").join(series.price_bounds(nav), "scheme_code", "left")
    reason = (F.when(F.col("known").isNull(), "unknown scheme")
               .when(F.col("first_date").isNull(), "no price history")
               .when(F.col("start_date") < F.col("first_date"), "starts before the fund's history")
               .when(F.col("start_date") >= F.col("latest_date"), "starts at or after the latest price"))
    cagr = _cagr_pct(F.try_divide(F.col("latest_nav"), F.col("first_nav")), F.datediff("latest_date", "first_date"))
    return checked.select("plan_id", reason.isNull().alias("is_valid"), reason.alias("reason"),
                          F.when(reason.isNull(), rnd(cagr, 2)).alias("fund_cagr_pct"))


def valid_plans(plans: DataFrame, master: DataFrame, nav: DataFrame) -> DataFrame:
    ok = plan_validity(plans, master, nav).filter("is_valid").select("plan_id")
    return plans.join(ok, "plan_id", "left_semi")


def schedule(start: Column, end: Column, freq: Column) -> Column:
    """Instalment dates from ``start`` to ``end``: the first as given, later ones
    one or three months apart on the same day, at most the 28th."""
    step = F.when(freq == "quarterly", 3).otherwise(1)
    month = F.trunc(start, "MM")
    months = F.months_between(F.trunc(end, "MM"), month).cast("int")

    def later(k: Column) -> Column:
        return F.date_add(F.add_months(month, k), F.least(F.dayofmonth(start), F.lit(28)) - 1)

    dates = F.transform(F.sequence(F.lit(0), F.greatest(months, F.lit(0)), step),
                        lambda k: F.when(k == 0, start).otherwise(later(k)))
    return F.filter(dates, lambda d: d <= end)


def sip_buys(plans: DataFrame, nav: DataFrame) -> DataFrame:
    """One row per instalment: its price day and price, the plan's bounds."""
    last = F.least(F.coalesce("last_instalment", "latest_date"), F.col("latest_date"))
    due = (_bounded(plans, nav)
           .select("plan_id", "scheme_code", "amount", "start_date", "first_date", "latest_date", "latest_nav",
                   F.posexplode(schedule(F.col("start_date"), last, F.col("freq"))).alias("k", "due")))
    return asof.next_price(due, nav, "due")


def sip_series(buys: DataFrame) -> DataFrame:
    """(plan_id, instalment, date, invested, value) after every instalment, valued
    at that day's price. A plan has at most one instalment a month."""
    upto = Window.partitionBy("plan_id").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    units = F.sum(F.try_divide("amount", "price")).over(upto)
    return buys.select("plan_id", F.col("k").alias("instalment"), F.col("price_date").alias("date"),
                       rnd(F.sum("amount").over(upto), 2).alias("invested"), rnd(units * F.col("price"), 2).alias("value"))


def _sip_totals(buys: DataFrame, *extra: Column) -> DataFrame:
    return buys.groupBy("plan_id", "scheme_code", "start_date", "latest_date", "latest_nav").agg(
        F.sum("amount").alias("paid"), F.sum(F.try_divide("amount", "price")).alias("bought"), *extra)


def _sip_summary(totals: DataFrame) -> DataFrame:
    value = F.col("bought") * F.col("latest_nav")
    gain = value - F.col("paid")
    return totals.select(
        "plan_id", "scheme_code", F.col("start_date").alias("start"), F.col("latest_date").alias("end"),
        rnd(F.col("paid"), 2).alias("invested"), rnd(F.col("bought"), 4).alias("units"),
        rnd(value, 2).alias("current_value"), rnd(gain, 2).alias("gain"),
        rnd(F.try_divide(gain, F.col("paid")) * 100, 2).alias("absolute_return_pct"))


def sip_summary(buys: DataFrame) -> DataFrame:
    """Invested, units, value and gain of every instalment plan."""
    return _sip_summary(_sip_totals(buys))


_CHAIN = ["scheme_code", "dom", "step", "phase"]


def _month_number(date: Column) -> Column:
    return F.year(date) * 12 + F.month(date) - 1


def _chained(plans: DataFrame, nav: DataFrame) -> DataFrame:
    """Plans with at least one instalment: their chain, the months of the first and the last instalment."""
    last = F.least(F.coalesce("last_instalment", "latest_date"), F.col("latest_date"))
    step, dom = F.when(F.col("freq") == "quarterly", 3).otherwise(1), F.least(F.dayofmonth("start_date"), F.lit(28))
    first_month, last_month = _month_number(F.col("start_date")), _month_number(last)
    # the last month counts if its day has come
    whole = F.greatest(last_month - F.when(F.dayofmonth(last) < dom, 1).otherwise(0) - first_month, F.lit(0))
    return (_bounded(plans, nav).filter(F.col("start_date") <= last)
            .select("plan_id", "scheme_code", "amount", "start_date", "first_date", "latest_date", "latest_nav", dom.alias("dom"),
                    step.alias("step"), (first_month % step).alias("phase"), first_month.alias("from_month"),
                    (first_month + whole - whole % step).alias("to_month")))


def unit_chains(plans: DataFrame, nav: DataFrame) -> DataFrame:
    """(scheme_code, dom, step, phase, month, due, units, bought): running units per unit of money, and how many purchases had a
    price, of buying on day ``dom`` of every month (step 1) or every third (step 3, by phase). A scheme has at most 28 days times
    4 chains, each with a row a month, however many plans share it."""
    chains = (_chained(plans, nav).filter(F.col("to_month") > F.col("from_month")).groupBy(*_CHAIN)
              .agg(F.min("from_month").alias("low"), F.max("to_month").alias("high"), F.min("first_date").alias("first_date")))
    due = (chains.select(*_CHAIN, "first_date", F.explode(F.sequence("low", "high", "step")).alias("month"))
                 .withColumn("due", F.make_date(F.floor(F.col("month") / 12).cast("int"), F.col("month") % 12 + 1, "dom")))
    upto = Window.partitionBy(*_CHAIN).orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inverse = F.try_divide(F.lit(1.0), F.col("price"))
    return asof.next_price(due, nav, "due").select(*_CHAIN, "month", "due", F.coalesce(F.sum(inverse).over(upto), F.lit(0.0)).alias("units"),
                                                   F.count(inverse).over(upto).alias("bought"))


def plan_summary(plans: DataFrame, nav: DataFrame) -> DataFrame:
    """``sip_summary`` of plans (one row per plan_id) without a row per instalment: the first purchase by its own price, the
    later ones as the difference of two rows of the scheme's running units."""
    rows = _chained(plans, nav)
    chains = settle(unit_chains(plans, nav), "unit-chains")
    starts = asof.next_price(rows, nav, "start_date").withColumn("inverse", F.try_divide(F.lit(1.0), F.col("price")))

    def at(month: str, name: str) -> DataFrame:
        return chains.select(*_CHAIN, F.col("month").alias(month), F.col("units").alias(f"{name}_units"), F.col("bought").alias(f"{name}_bought"))

    joined = (starts.join(at("from_month", "first"), [*_CHAIN, "from_month"], "left")
                    .join(at("to_month", "last"), [*_CHAIN, "to_month"], "left"))
    later = F.col("to_month") > F.col("from_month")
    priced = later & (F.col("last_bought") > F.col("first_bought"))
    units = F.when(F.col("inverse").isNotNull() | priced,
                   F.coalesce("inverse", F.lit(0.0)) + F.when(priced, F.col("last_units") - F.col("first_units")).otherwise(0.0))
    count = 1 + (F.col("to_month") - F.col("from_month")) / F.col("step")
    return _sip_summary(joined.withColumns({"paid": F.col("amount") * count, "bought": F.col("amount") * units}))


def _solver():
    """The Arrow function that finds the rates of a batch of flow lists: every list takes its own Newton steps, all lists
    together, and leaves when it is done. It carries what it needs, so that workers import nothing of this library."""
    import numpy as np
    import pandas as pd
    first, steps, least_slope, tolerance = K.XIRR_GUESS, K.XIRR_STEPS, K.XIRR_MIN_SLOPE, K.XIRR_TOLERANCE

    def solved(years, amounts):
        answers = np.full(len(years), np.nan)
        at = np.array([i for i, flows in enumerate(years) if flows is not None and len(flows)], dtype=np.int64)
        if len(at):
            t, a = (np.concatenate([lists.iloc[i] for i in at]).astype(float) for lists in (years, amounts))
            owner, rate = np.repeat(np.arange(len(at)), [len(years.iloc[i]) for i in at]), np.full(len(at), first)
        with np.errstate(all="ignore"):
            for _ in range(steps):
                if not len(at):
                    break
                growth = (1 + rate)[owner]
                power, higher = growth ** t, growth ** (t + 1)
                power[power == 0], higher[higher == 0] = np.nan, np.nan  # nothing is divided by an underflow
                # bincount adds up in the order of the flows
                f, fp = np.bincount(owner, a / power), -np.bincount(owner, t * a / higher)
                moved, flat = rate - f / fp, np.abs(fp) < least_slope
                found = ~flat & (np.abs(moved - rate) < tolerance)
                answers[at[found]] = moved[found]
                on = ~(flat | found | np.isnan(moved) | (moved <= -1))
                stays = on[owner]
                t, a, owner = t[stays], a[stays], (np.cumsum(on) - 1)[owner[stays]]
                at, rate = at[on], moved[on]
        return pd.Series(answers)

    solved.__annotations__ = {"years": pd.Series, "amounts": pd.Series, "return": pd.Series}
    return F.pandas_udf(solved, "double")


def xirr(flows: Column) -> Column:
    """Money-weighted annual rate of ``flows`` (array of struct(t years, a amount)),
    by Newton steps from 10%; null without both signs, when 1 + rate is not
    positive, when the slope vanishes, or after 100 steps. Needs numpy, pandas and pyarrow."""
    signs = F.exists(flows, lambda x: x["a"] < 0) & F.exists(flows, lambda x: x["a"] > 0)
    asked = F.when((F.size(flows) >= 2) & signs, flows)
    return rnd(_solver()(F.transform(asked, lambda x: x["t"]), F.transform(asked, lambda x: x["a"])), 6)


def sip_xirr(buys: DataFrame) -> DataFrame:
    """(plan_id, xirr_pct). A plan's flows are one per instalment plus the
    redemption, at most one a month, so the array stays small."""
    totals = _sip_totals(buys, F.min("price_date").alias("t0"),
                         F.collect_list(F.struct("k", "price_date", F.col("amount").alias("amount"))).alias("buys"))
    flows = F.concat(
        F.transform(F.array_sort("buys"), lambda b: F.struct((F.datediff(b["price_date"], F.col("t0")) / 365.0).alias("t"),
                                                             (-b["amount"]).alias("a"))),
        F.array(F.struct((F.datediff("latest_date", "t0") / 365.0).alias("t"),
                         (F.col("bought") * F.col("latest_nav")).alias("a"))))
    return (totals.withColumn("flows", flows)
                  .select("plan_id", rnd(xirr(F.col("flows")) * 100, 2).alias("xirr_pct")))


def _lumpsum_buys(plans: DataFrame, nav: DataFrame) -> DataFrame:
    held = asof.next_price(_bounded(plans, nav), nav, "start_date")
    return held.withColumn("units", F.try_divide("amount", "price"))


def lumpsum_summary(plans: DataFrame, nav: DataFrame) -> DataFrame:
    """Units, value, gain and CAGR of one purchase at the plan's start; the plan's
    last_instalment plays no part."""
    value = F.col("units") * F.col("latest_nav")
    gain = value - F.col("amount")
    return _lumpsum_buys(plans, nav).select(
        "plan_id", "scheme_code", F.col("price_date").alias("start"), F.col("latest_date").alias("end"),
        rnd(F.col("amount"), 2).alias("invested"), rnd(F.col("units"), 4).alias("units"),
        rnd(value, 2).alias("current_value"), rnd(gain, 2).alias("gain"),
        rnd(F.try_divide(gain, F.col("amount")) * 100, 2).alias("absolute_return_pct"),
        rnd(_cagr_pct(F.try_divide(value, F.col("amount")), F.datediff("latest_date", "price_date")), 2).alias("cagr_pct"))


def lumpsum_series(plans: DataFrame, nav: DataFrame) -> DataFrame:
    """(plan_id, date, invested, value) at the purchase and at the first price of
    every later month. Months are matched by equality, so the series costs one
    row per plan and month, not per plan and day."""
    firsts = (nav.groupBy("scheme_code", F.trunc("date", "MM").alias("month"))
                 .agg(F.min("date").alias("date"), F.min_by("nav", "date").alias("nav")))
    held = _lumpsum_buys(plans, nav)
    value = F.col("units") * F.col("nav")
    bought = held.select("plan_id", "amount", "units", F.col("price_date").alias("date"), F.col("price").alias("nav"))
    bought_month, latest_month = F.trunc("price_date", "MM"), F.trunc("latest_date", "MM")
    later = (held.filter(bought_month < latest_month)
             .select("plan_id", "scheme_code", "amount", "units",
                     F.explode(F.expr("sequence(add_months(trunc(price_date, 'MM'), 1), trunc(latest_date, 'MM'), interval 1 month)")).alias("month"))
             .join(firsts, ["scheme_code", "month"]).select("plan_id", "amount", "units", "date", "nav"))
    return bought.unionByName(later).select("plan_id", "date", rnd(F.col("amount"), 2).alias("invested"), rnd(value, 2).alias("value"))
