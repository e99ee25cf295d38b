"""Rolling returns: the return of every window of nine lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from navloom import constants as K
from navloom.functions.rounding import rnd
from navloom.operators import asof, series
from navloom.session import settle


def _wide(nav: DataFrame, windows: dict[str, int]) -> DataFrame:
    """(scheme_code, date, day, rets): one row per start day, the return of each window in
    order, null where it has none. All frames share one sort of the series."""
    rows = series.with_jumps(nav).withColumn("day", F.unix_date("date"))
    ends = rows.select("scheme_code", "date", "day", "nav", "jumps",
                       *(asof.window_end(["date", "nav", "jumps"], days, "day").alias(w) for w, days in windows.items()))

    def ret(window: str, annual: bool) -> Column:
        end = F.col(window)
        growth = end["nav"] / F.col("nav")
        value = F.power(growth, 1 / (F.datediff(end["date"], "date") / 365.0)) - 1 if annual else growth - 1
        return F.when((F.col("nav") > 0) & (end["nav"] > 0) & (end["jumps"] == F.col("jumps")), value * 100)

    return ends.select("scheme_code", "date", "day", F.array(*(ret(w, days >= 365) for w, days in windows.items())).alias("rets"))


def rolling_returns(nav: DataFrame, windows: dict[str, int] = K.ROLLING_DAYS) -> DataFrame:
    """(scheme_code, window, date, ret) for every start day whose window closes on
    a price at most a week late, has positive prices at both ends and no jump
    inside. Windows of a year and more are annualised on actual days."""
    names = F.array(*map(F.lit, windows))
    return (_wide(nav, windows).select("scheme_code", "date", F.posexplode("rets").alias("i", "ret"))
            .filter(F.col("ret").isNotNull()).select("scheme_code", F.get(names, F.col("i")).alias("window"), "date", "ret"))


def _share(condition: Column) -> Column:
    return rnd(F.avg(F.when(condition, 1.0).otherwise(0.0)) * 100, 1)


def rolling_stats(nav: DataFrame, master: DataFrame, proxies: DataFrame,
                  windows: dict[str, int] = K.ROLLING_DAYS) -> DataFrame:
    """Distribution of rolling returns per scheme and window with at least 30
    windows, and how often the category's proxy was beaten on shared start days
    (null below 30 of them, and for the proxy itself)."""
    links = proxies.select("category", "proxy_scheme_code")
    proxy_codes = links.select(F.col("proxy_scheme_code").alias("scheme_code")).distinct()
    # one row per proxy and day, settled: the planner knows its size when it picks the join
    bench = settle(_wide(nav.join(proxy_codes, "scheme_code", "left_semi"), windows).select(
        F.col("scheme_code").alias("proxy_scheme_code"), "date", F.col("rets").alias("proxy_rets")), "benchmarks")
    dims = (master.select("scheme_code", "category").join(links, "category", "left")
                  .withColumn("proxy_scheme_code", F.when(F.col("proxy_scheme_code") != F.col("scheme_code"), F.col("proxy_scheme_code")))
                  .select("scheme_code", "proxy_scheme_code"))
    # hashing the small side per partition leaves the points where their windows put them
    starts = (_wide(nav, windows).join(dims.hint("shuffle_hash"), "scheme_code")
              .join(bench, ["proxy_scheme_code", "date"], "left"))
    names = F.array(*map(F.lit, windows))
    points = (starts.select("scheme_code", "proxy_rets", F.posexplode("rets").alias("i", "ret")).filter(F.col("ret").isNotNull())
              .select("scheme_code", F.get(names, F.col("i")).alias("window"), "ret", F.get("proxy_rets", F.col("i")).alias("proxy_ret")))
    ret, shared = F.col("ret"), F.col("proxy_ret").isNotNull()
    stats = points.groupBy("scheme_code", "window").agg(
        F.count(F.lit(1)).alias("windows"), F.min("ret").alias("lo"), F.max("ret").alias("hi"), F.avg("ret").alias("mean"),
        F.percentile("ret", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"),
        _share(ret < 0).alias("pct_negative"), _share(ret >= 8).alias("pct_above_8"), _share(ret >= 12).alias("pct_above_12"),
        F.count("proxy_ret").alias("shared"),
        rnd(F.avg(F.when(shared, F.when(ret > F.col("proxy_ret"), 1.0).otherwise(0.0))) * 100, 1).alias("beat"))
    return stats.filter(F.col("windows") >= K.MIN_ROLLING_WINDOWS).select(
        "scheme_code", "window", "windows", rnd(F.col("lo"), 2).alias("min"), rnd(F.col("q")[0], 2).alias("p25"),
        rnd(F.col("q")[1], 2).alias("median"), rnd(F.col("mean"), 2).alias("avg"), rnd(F.col("q")[2], 2).alias("p75"),
        rnd(F.col("hi"), 2).alias("max"), "pct_negative", "pct_above_8", "pct_above_12",
        F.when(F.col("shared") >= K.MIN_ROLLING_WINDOWS, F.col("beat")).alias("beat_benchmark_pct"))


def rolling_points(nav: DataFrame, windows: dict[str, int] = K.ROLLING_DAYS,
                   max_points: int = K.MAX_CHART_POINTS) -> DataFrame:
    """The rolling series evenly thinned for charts, always with its last point. Places are counted along the series beside
    its windows, so that only points that stay are ever made rows of their own, and nothing is sorted again."""
    upto = series.by_day_number("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # the order of the windows' own frames
    rows = _wide(nav, windows)
    for i in range(len(windows)):
        some = F.count(F.get("rets", F.lit(i)))
        rows = rows.withColumns({f"i_{i}": some.over(upto) - 1, f"n_{i}": some.over(Window.partitionBy("scheme_code"))})

    def stays(i: int) -> Column:
        place, n = F.col(f"i_{i}"), F.col(f"n_{i}")
        return F.get("rets", F.lit(i)).isNotNull() & ((place % F.greatest(F.lit(1), F.ceil(n / max_points)) == 0) | (place == n - 1))

    points = F.array(*(F.when(stays(i), F.struct(F.lit(w).alias("window"), F.get("rets", F.lit(i)).alias("ret"))) for i, w in enumerate(windows)))
    return (rows.select("scheme_code", "date", F.explode(F.array_compact(points)).alias("p"))
            .select("scheme_code", "p.window", "date", rnd(F.col("p.ret"), 2).alias("ret")))
