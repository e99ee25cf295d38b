"""Volatility, Sharpe, drawdown, beta and alpha over one and three years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from navloom import constants as K
from navloom.functions.rounding import rnd
from navloom.operators import series
from navloom.session import settle

_SLICE_DAYS = K.RISK_DAYS["3Y"] + K.RISK_HISTORY_SLACK_DAYS


def _daily_steps(nav: DataFrame, as_of: str) -> DataFrame:
    """(scheme_code, date, nav, ret, windows): the daily steps of the recent slice, each
    with the windows that it lies in and their running peaks. Both windows share
    one sort on (scheme_code, date)."""
    day, w = F.lit(as_of).cast("date"), series.by_date()
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = (nav.filter(F.col("date") >= F.date_sub(day, _SLICE_DAYS))
                .withColumn("prev", F.lag("nav").over(w))
                .withColumn("ret", F.try_divide(F.col("nav"), F.col("prev")) - 1))
    # the first row of the slice has no step and belongs to no window
    inside = {p: (F.col("date") >= F.date_sub(day, days)) & F.col("prev").isNotNull() for p, days in K.RISK_DAYS.items()}
    steps = steps.withColumns({f"peak{p}": F.max(F.when(inside[p], F.col("nav"))).over(upto) for p in inside})
    windows = F.filter(F.array(*(F.struct(F.lit(p).alias("period"), F.col(f"peak{p}").alias("peak"), inside[p].alias("inside"))
                                 for p in inside)), lambda x: x["inside"])
    return steps.select("scheme_code", "date", "nav", "ret", windows.alias("windows"))


def _per_window(steps: DataFrame) -> DataFrame:
    """A row per step and window: period and peak beside the step's own columns."""
    own = [c for c in steps.columns if c != "windows"]
    return steps.select(*own, F.explode("windows").alias("w")).select(*own, "w.period", "w.peak")


def _window_metrics(steps: DataFrame, *extra: Column) -> DataFrame:
    grouped = steps.groupBy("scheme_code", "period").agg(
        F.count(F.lit(1)).alias("n"), F.count("ret").alias("defined"), F.max(F.abs("ret")).alias("largest"),
        F.stddev_samp("ret").alias("sd"), F.min_by("nav", "date").alias("first"), F.max_by("nav", "date").alias("last"),
        F.min(F.try_divide(F.col("nav"), F.col("peak")) - 1).alias("drawdown"), *extra)
    return usable_windows(grouped)


def usable_windows(grouped: DataFrame) -> DataFrame:
    """The windows with at least 150 steps, all defined, and no jump, with their ``annual`` growth."""
    usable = (F.col("n") >= K.MIN_RISK_POINTS) & (F.col("defined") == F.col("n")) & (F.col("largest") <= K.JUMP_LIMIT)
    growth = F.try_divide(F.col("last"), F.col("first"))
    return grouped.filter(usable).withColumn("annual", (F.power(growth, K.TRADING_DAYS / F.col("n")) - 1) * 100)


def scheme_risk(nav: DataFrame, master: DataFrame, proxies: DataFrame, as_of: str) -> DataFrame:
    """One row per scheme and usable window. Beta and alpha need the category's
    proxy on at least 90% of the steps (and 150) and a usable window of its own,
    and are not given for the proxy itself."""
    links = proxies.select("category", "proxy_scheme_code")
    proxy_nav = nav.join(links.select(F.col("proxy_scheme_code").alias("scheme_code")).distinct(), "scheme_code", "left_semi")
    # one row per proxy and day, and one per proxy and window, settled: the planner knows their size
    proxy_steps = settle(_daily_steps(proxy_nav, as_of), "proxy-steps")
    proxy_rets = settle(proxy_steps.filter(F.col("ret").isNotNull()).select(
        F.col("scheme_code").alias("proxy_scheme_code"), "date", F.col("ret").alias("proxy_ret")), "proxy-returns")
    proxy_annual = settle(_window_metrics(_per_window(proxy_steps)).select(
        F.col("scheme_code").alias("proxy_scheme_code"), "period", F.col("annual").alias("proxy_annual")), "proxy-growth")

    schemes = proxy_links(master, proxies)
    # hashing the small side per partition leaves the steps where their windows put them
    steps = _per_window(_daily_steps(nav, as_of).join(schemes.hint("shuffle_hash"), "scheme_code")
                        .join(proxy_rets, ["proxy_scheme_code", "date"], "left"))
    paired = F.when(F.col("proxy_ret").isNotNull(), F.col("ret"))
    rows = (_window_metrics(steps, F.count("proxy_ret").alias("pairs"), F.covar_samp(paired, "proxy_ret").alias("cov"),
                            F.var_samp("proxy_ret").alias("var"))
            .join(schemes, "scheme_code").join(proxy_annual, ["proxy_scheme_code", "period"], "left"))
    return figures(rows, as_of)


def proxy_links(master: DataFrame, proxies: DataFrame) -> DataFrame:
    """(scheme_code, proxy_scheme_code) of the schemes that get risk rows; null for the proxy itself."""
    is_self = F.col("proxy_scheme_code") == F.col("scheme_code")
    return (master.filter(F.col("backfill_status") == "done").join(proxies.select("category", "proxy_scheme_code"), "category", "left")
                  .select("scheme_code", F.when(~is_self, F.col("proxy_scheme_code")).alias("proxy_scheme_code")))


def figures(rows: DataFrame, as_of: str) -> DataFrame:
    """scheme_risk from usable windows beside their proxy's growth."""
    stdev = F.col("sd") * (K.TRADING_DAYS ** 0.5) * 100
    covered = ((F.col("pairs") >= K.MIN_RISK_POINTS) & (F.col("var") > 0) & F.col("proxy_annual").isNotNull()
               & (F.col("pairs") / F.col("n") >= K.MIN_PROXY_COVERAGE))
    beta = F.when(covered, F.try_divide(F.col("cov"), F.col("var")))
    alpha = F.col("annual") - (K.RISK_FREE_PCT + beta * (F.col("proxy_annual") - K.RISK_FREE_PCT))
    return rows.select(
        "scheme_code", "period", rnd(stdev, 2).alias("stdev"),
        F.when(stdev > 0, rnd(F.try_divide(F.col("annual") - K.RISK_FREE_PCT, stdev), 2)).alias("sharpe"),
        rnd(beta, 2).alias("beta"), rnd(alpha, 2).alias("alpha"), rnd(F.col("drawdown") * 100, 2).alias("max_drawdown"),
        F.lit(as_of).cast("date").alias("as_of_date"))
