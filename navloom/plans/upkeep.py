"""Returns and risk kept up batch by batch, from a summary of every scheme's months instead of its days.

A month of a scheme is summed up by its first and last price and, for the steps between its own days, by what can be put
together again: counts, sums and products of the returns (with the benchmark's beside them), the largest step, the dates of
jumps, and the peak, the trough and the deepest fall. The step into a month is taken from the last price of the month before
when summaries are put together, so a changed price changes one summary. A window takes the summaries of its whole
months and the days of the month that its edge cuts: days leave it without being taken off any sum.

    <state>/months    the summaries, a part a year
    <state>/returns   scheme_returns, a part a slice of the schemes
    <state>/risk      scheme_risk, likewise
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from navloom import constants as K
from navloom import schemas
from navloom.operators import asof, series
from navloom.operators.merge import replace_groups
from navloom.plans import returns, risk
from navloom.session import settle
from navloom.sources import prices, versions

SLICES = 16  # of the schemes, by hash: a batch rewrites those that it touches
_STEPS = ("n BIGINT, defined BIGINT, largest DOUBLE, s1 DOUBLE, s2 DOUBLE, jumps ARRAY<DATE>, peak DOUBLE, trough DOUBLE, fall DOUBLE, second_nav DOUBLE, "
          "pairs BIGINT, px DOUBLE, py DOUBLE, pxy DOUBLE, pyy DOUBLE")
SUMMARY = f"scheme_code STRING, month STRING, first_date DATE, first_nav DOUBLE, first_proxy DOUBLE, last_date DATE, last_nav DOUBLE, {_STEPS}"
_YEAR = "substr(month, 1, 4)"
_SLICE = f"lpad(CAST(pmod(xxhash64(scheme_code), {SLICES}) AS STRING), 4, '0')"


def _month(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def month_summaries(nav: DataFrame, links: DataFrame, proxy_rets: DataFrame) -> DataFrame:
    """The summary of each (scheme, month) among whole months of prices. ``links`` (scheme_code, proxy_scheme_code) says
    whose returns ``proxy_rets`` (proxy_scheme_code, date, proxy_ret) are paired with."""
    days = Window.partitionBy("scheme_code", "month").orderBy("date")
    inner = F.col("prev").isNotNull()
    rows = (nav.withColumn("month", _month(F.col("date"))).join(links, "scheme_code", "left").join(proxy_rets, ["proxy_scheme_code", "date"], "left")
            .withColumn("prev", F.lag("nav").over(days)))
    rows = (rows.withColumn("ret", F.try_divide(F.col("nav"), F.col("prev")) - 1).withColumn("inner_nav", F.when(inner, F.col("nav")))
            .withColumn("running", F.max("inner_nav").over(days.rowsBetween(Window.unboundedPreceding, 0))))
    x, y = F.col("ret"), F.when(inner, F.col("proxy_ret"))
    x_of_pair = F.when(y.isNotNull(), x)
    summed = rows.groupBy("scheme_code", "month").agg(
        F.min("date").alias("first_date"), F.min_by("nav", "date").alias("first_nav"), F.min_by("proxy_ret", "date").alias("first_proxy"),
        F.max("date").alias("last_date"), F.max_by("nav", "date").alias("last_nav"),
        F.count("prev").alias("n"), F.count("ret").alias("defined"), F.max(F.abs("ret")).alias("largest"), F.sum(x).alias("s1"), F.sum(x * x).alias("s2"),
        F.bit_or(F.when(F.abs("ret") > K.JUMP_LIMIT, F.expr("shiftleft(1, day(date) - 1)"))).alias("jump_days"),  # a bit a day keeps this a hash aggregate
        F.max("inner_nav").alias("peak"), F.min("inner_nav").alias("trough"), F.min(F.try_divide(F.col("inner_nav"), F.col("running")) - 1).alias("fall"),
        F.min_by("inner_nav", F.when(inner, F.col("date"))).alias("second_nav"),
        F.count(y).alias("pairs"), F.sum(x_of_pair).alias("px"), F.sum(y).alias("py"), F.sum(x_of_pair * y).alias("pxy"), F.sum(y * y).alias("pyy"))
    jumps = F.expr("filter(sequence(trunc(last_date, 'MM'), last_day(last_date)), d -> (shiftright(jump_days, day(d) - 1) & 1) = 1)")
    return summed.withColumn("jumps", F.when(F.col("jump_days") != 0, jumps).otherwise(F.array().cast("array<date>"))).drop("jump_days")


def _as_elements(nav: DataFrame, links: DataFrame, proxy_rets: DataFrame) -> DataFrame:
    """Single days in the shape of summaries without inner steps."""
    rows = nav.join(links, "scheme_code", "left").join(proxy_rets, ["proxy_scheme_code", "date"], "left")
    empty = [F.lit(0 if kind == "BIGINT" else None).cast(kind).alias(name) for name, kind in (c.split() for c in _STEPS.split(", "))]
    return rows.select("scheme_code", _month(F.col("date")).alias("month"), F.col("date").alias("first_date"), F.col("nav").alias("first_nav"),
                       F.col("proxy_ret").alias("first_proxy"), F.col("date").alias("last_date"), F.col("nav").alias("last_nav"), *empty)


def _edges(as_of: str) -> dict[str, dt.date]:
    return {p: dt.date.fromisoformat(as_of) - dt.timedelta(days) for p, days in K.RISK_DAYS.items()}


def _months_between(first: dt.date, last: dt.date) -> list[tuple[int, int]]:
    return [(m // 12, m % 12 + 1) for m in range(first.year * 12 + first.month - 1, last.year * 12 + last.month)]


def edge_months(as_of: str) -> list[tuple[int, int]]:
    """Months whose days a window needs: those before the longest window's first whole month, and each edge's own."""
    edges = _edges(as_of).values()
    longest = min(edges)
    slack = longest - dt.timedelta(K.RISK_HISTORY_SLACK_DAYS)
    return sorted({*_months_between(slack, longest), *((e.year, e.month) for e in edges)})


def window_parts(summaries: DataFrame, days: DataFrame, links: DataFrame, proxy_rets: DataFrame, as_of: str) -> DataFrame:
    """One row per scheme and usable window with what the risk figures need, put together from summaries and from the
    days of the edge months."""
    edges = _edges(as_of)
    longest = min(edges.values())
    slack = longest - dt.timedelta(K.RISK_HISTORY_SLACK_DAYS)
    singles = _as_elements(days.filter(F.col("date") >= F.lit(slack)), links, proxy_rets)
    by_period = []
    for period, start in edges.items():
        cut = sorted({f"{longest:%Y-%m}", f"{start:%Y-%m}"})
        month = F.col("month")
        whole = summaries.filter((month > cut[0]) & ~month.isin(cut)).withColumn("inside", F.col("month") > f"{start:%Y-%m}")
        single = singles.filter((month <= cut[0]) | month.isin(cut)).withColumn("inside", F.col("first_date") >= F.lit(start))
        by_period.append(whole.select(*singles.columns, "inside").unionByName(single).withColumn("period", F.lit(period)))
    rows = by_period[0]
    for other in by_period[1:]:
        rows = rows.unionByName(other)

    order = Window.partitionBy("scheme_code", "period").orderBy("first_date")
    rows = rows.withColumn("prev", F.lag("last_nav").over(order))
    first, inner = F.col("inside") & F.col("prev").isNotNull(), F.col("inside") & (F.col("n") > 0)
    rows = rows.withColumn("first_in", first).withColumn("inner_in", inner).withColumn("ret", F.when(first, F.try_divide(F.col("first_nav"), F.col("prev")) - 1))
    nav = F.when(F.col("first_in"), F.col("first_nav"))

    def of_inner(column: str) -> Column:
        return F.when(F.col("inner_in"), F.col(column))

    rows = rows.withColumn("top", F.greatest(nav, of_inner("peak"))).withColumn("low", F.least(nav, of_inner("trough")))
    rows = rows.withColumn("peak_before", F.max("top").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    own_fall = F.least(F.when(F.col("first_in"), F.lit(0.0)), of_inner("fall"), F.try_divide(of_inner("trough"), nav) - 1)
    fall = F.least(own_fall, F.try_divide(F.col("low"), F.col("peak_before")) - 1)
    x, y = F.col("ret"), F.when(F.col("first_in"), F.col("first_proxy"))
    x_of_pair = F.when(y.isNotNull(), x)

    def total(step: Column, column: str) -> Column:
        return F.sum(F.coalesce(step, F.lit(0)) + F.coalesce(of_inner(column), F.lit(0)))

    some = F.col("first_in") | F.col("inner_in")
    sums = rows.groupBy("scheme_code", "period").agg(
        total(F.col("first_in").cast("bigint"), "n").alias("n"), total(x.isNotNull().cast("bigint"), "defined").alias("defined"),
        F.max(F.greatest(F.abs(x), of_inner("largest"))).alias("largest"), total(x, "s1").alias("s1"), total(x * x, "s2").alias("s2"),
        F.min_by(F.coalesce(nav, of_inner("second_nav")), F.when(some, F.col("first_date"))).alias("first"),
        F.max_by("last_nav", F.when(some, F.col("first_date"))).alias("last"), F.min(fall).alias("drawdown"),
        total(y.isNotNull().cast("bigint"), "pairs").alias("pairs"), total(x_of_pair, "px").alias("px"), total(y, "py").alias("py"),
        total(x_of_pair * y, "pxy").alias("pxy"), total(y * y, "pyy").alias("pyy"))

    def spread(product: str, a: str, b: str, n: str) -> Column:
        return F.when(F.col(n) > 1, F.try_divide(F.col(product) - F.try_divide(F.col(a) * F.col(b), F.col(n)), F.col(n) - 1))

    return risk.usable_windows(sums.withColumn("sd", F.sqrt(F.greatest(spread("s2", "s1", "s1", "n"), F.lit(0.0))))
                               .withColumn("cov", spread("pxy", "px", "py", "pairs")).withColumn("var", spread("pyy", "py", "py", "pairs")))


def returns_from_summaries(summaries: DataFrame, band_days: DataFrame) -> DataFrame:
    """scheme_returns: the latest price and the jumps from summaries, the anchors from the days of their bands."""
    own = Window.partitionBy("scheme_code").orderBy("first_date")
    change = F.try_divide(F.col("first_nav"), F.lag("last_nav").over(own)) - 1
    into = F.when(F.abs(change) > K.JUMP_LIMIT, F.array("first_date")).otherwise(F.array().cast("array<date>"))
    known = (summaries.withColumn("all_jumps", F.concat(into, F.coalesce("jumps", F.array().cast("array<date>")))).groupBy("scheme_code")
             .agg(F.max("last_date").alias("as_of_date"), F.max_by("last_nav", "last_date").alias("nav"), F.flatten(F.collect_list("all_jumps")).alias("dates")))
    band = band_days.withColumnRenamed("nav", "price").join(known.select("scheme_code", "as_of_date"), "scheme_code")
    anchors = band.groupBy("scheme_code").agg(*(asof.anchor(F.col(c), F.col("date"), F.col("as_of_date"), days).alias(f"{c}{p}")
                                                for p, days in K.PERIOD_DAYS.items() for c in ("price", "date")))
    rows = known.join(anchors, "scheme_code")

    def jumps_after(date: Column) -> Column:
        return F.size(F.filter("dates", lambda d: d > date))

    periods = F.explode(F.array(*(F.struct(F.lit(p).alias("period"), F.lit(float(days // returns.DAYS_PER_YEAR)).alias("years"), F.col(f"price{p}").alias("anchor"),
                                           jumps_after(F.col(f"date{p}")).alias("anchor_jumps")) for p, days in K.PERIOD_DAYS.items())))
    flat = rows.select("scheme_code", "as_of_date", "nav", F.lit(0).alias("jumps"), periods.alias("p")).select("scheme_code", "as_of_date", "nav", "jumps", "p.*")
    return returns.from_anchors(flat)


def band_months(latest: DataFrame) -> list[tuple[int, int]]:
    """Months that the anchors of schemes with the given newest dates can lie in; bounded by the calendar."""
    target = F.explode(F.array(*(F.struct(F.date_sub("as_of_date", days).alias("to"), F.date_sub("as_of_date", days + K.ANCHOR_TOLERANCE_DAYS - 1).alias("since"))
                                 for days in K.PERIOD_DAYS.values())))
    ends = latest.select(target.alias("t")).select(F.explode(F.array("t.since", "t.to")).alias("day"))
    return [(r.y, r.m) for r in ends.select(F.year("day").alias("y"), F.month("day").alias("m")).distinct().collect()]


def _replace_schemes(new: DataFrame, schemes: DataFrame, root: str, schema: str) -> None:
    """Puts the new rows of the given schemes in place of their old ones; a scheme without new rows loses its old."""
    marks = schemes.select("scheme_code", *(F.lit(None).cast(f.dataType).alias(f.name) for f in new.schema.fields if f.name != "scheme_code"))
    versions.merge(new.select("scheme_code", *(c for c in new.columns if c != "scheme_code")).unionByName(marks), root, schema, _SLICE, ["scheme_code"],
                   lambda stored, incoming: replace_groups(stored, incoming, ["scheme_code"]).filter(F.col("period").isNotNull()))


def refresh(spark: SparkSession, store: str, state: str, keys: DataFrame, master: DataFrame, proxies: DataFrame, as_of: str) -> None:
    """Brings the state up to the store after prices of ``keys`` (scheme_code, month) have changed. Only the summaries of those
    months are made anew, and only the schemes in them are read and written; a benchmark's months concern all schemes that are
    measured by it. Doing so again changes nothing, so a refresh that died is repeated. Another ``as_of`` needs keys of every
    scheme, as its windows end elsewhere, but no days beyond those of the edge months."""
    links = settle(risk.proxy_links(master, proxies), "links")
    codes = [r[0] for r in proxies.select("proxy_scheme_code").distinct().collect()]  # a handful of funds
    proxy_rets = settle(prices.read_prices(spark, store).filter(F.col("scheme_code").isin(codes))
                        .withColumn("proxy_ret", F.try_divide(F.col("nav"), F.lag("nav").over(series.by_date())) - 1)
                        .select(F.col("scheme_code").alias("proxy_scheme_code"), "date", "proxy_ret").filter("proxy_ret IS NOT NULL"), "proxy-returns")
    moved = keys.filter(F.col("scheme_code").isin(codes))
    after = F.date_format(F.add_months(F.to_date(F.concat("month", F.lit("-01"))), 1), "yyyy-MM")  # its first step starts from the moved month
    moved = moved.unionByName(moved.withColumn("month", after)).withColumnRenamed("scheme_code", "proxy_scheme_code").distinct()
    keys = settle(keys.unionByName(links.join(moved, "proxy_scheme_code").select("scheme_code", "month")).distinct(), "touched")
    months = [tuple(map(int, r.month.split("-"))) for r in keys.select("month").distinct().collect()]
    if not months:
        return
    nav = prices.read_prices(spark, store, months).withColumn("month", _month(F.col("date"))).join(keys, ["scheme_code", "month"], "left_semi").drop("month")
    versions.merge(month_summaries(nav, links, proxy_rets).select(*(c.split()[0] for c in SUMMARY.split(", "))), f"{state}/months", SUMMARY, _YEAR, ["scheme_code", "month"],
                   lambda stored, incoming: replace_groups(stored, incoming, ["scheme_code", "month"]))

    schemes = settle(keys.select("scheme_code").distinct(), "touched-schemes")
    wanted = schemes.unionByName(spark.createDataFrame([(c,) for c in codes], "scheme_code STRING")).distinct()
    summaries = settle(versions.read(spark, f"{state}/months", SUMMARY).join(wanted, "scheme_code", "left_semi"), "summaries")
    latest = settle(summaries.groupBy("scheme_code").agg(F.max("last_date").alias("as_of_date")), "latest")
    bands = prices.read_prices(spark, store, band_months(latest)).join(schemes, "scheme_code", "left_semi")
    _replace_schemes(returns_from_summaries(summaries.join(schemes, "scheme_code", "left_semi"), bands), schemes, f"{state}/returns", schemas.SCHEME_RETURNS)

    days = prices.read_prices(spark, store, edge_months(as_of)).join(wanted, "scheme_code", "left_semi")
    parts = settle(window_parts(summaries, days, links, proxy_rets, as_of), "window-parts")
    proxy_annual = parts.filter(F.col("scheme_code").isin(codes)).select(F.col("scheme_code").alias("proxy_scheme_code"), "period", F.col("annual").alias("proxy_annual"))
    rows = parts.join(schemes, "scheme_code", "left_semi").join(links, "scheme_code").join(proxy_annual, ["proxy_scheme_code", "period"], "left")
    _replace_schemes(risk.figures(rows, as_of), schemes, f"{state}/risk", schemas.SCHEME_RISK)


def ingest(spark: SparkSession, store: str, state: str, batch: DataFrame, master: DataFrame, proxies: DataFrame, as_of: str) -> None:
    """Merges a batch of prices into the store and brings the state up to it."""
    batch = settle(batch.select("scheme_code", "date", "nav").filter("date IS NOT NULL"), "batch")
    prices.merge_into_store(spark, store, batch, settled=True)
    refresh(spark, store, state, batch.select("scheme_code", _month(F.col("date")).alias("month")).distinct(), master, proxies, as_of)


def scheme_returns(spark: SparkSession, state: str) -> DataFrame:
    return versions.read(spark, f"{state}/returns", schemas.SCHEME_RETURNS)


def scheme_risk(spark: SparkSession, state: str) -> DataFrame:
    return versions.read(spark, f"{state}/risk", schemas.SCHEME_RISK)
