"""Listing, detail and chart tables over the computed metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from navloom import constants as K
from navloom.operators import series
from navloom.operators.positions import top_k
from navloom.plans.overlap import latest_holdings
from navloom.plans.peers import percentile_band, top_share_label
from navloom.plans.quality import quality_note, usable
from navloom.plans.returns import period_position

_SORTS = {"name": "name", "nav": "nav", "1Y": "ret_1y", "3Y": "ret_3y", "5Y": "ret_5y",
          "sharpe": "sharpe_3y", "aum": "aaum_cr"}


def _period_value(value: str, period: str, name: str) -> Column:
    return F.max(F.when(F.col("period") == period, F.col(value))).alias(name)


def scheme_card(master: DataFrame, nav: DataFrame, returns: DataFrame, risk: DataFrame, ranks: DataFrame,
                costs: DataFrame, aum: DataFrame, proxies: DataFrame) -> DataFrame:
    """One wide row per scheme: attributes, newest price, cost and size, headline
    metrics, benchmark. Every metric table is cut to one row per scheme first, so
    each join is one to one."""
    price = series.price_bounds(nav).select("scheme_code", F.col("latest_nav").alias("nav"), F.col("latest_date").alias("nav_date"))
    cost = series.latest_by(costs, "scheme_code", "as_of_date", ter="ter", ter_as_of="as_of_date")
    size = series.latest_by(aum, "scheme_code", "as_of_date", aaum_cr="aaum_cr", aaum_as_of="as_of_date")
    rets = returns.groupBy("scheme_code").agg(*(_period_value("ret", p, f"ret_{p.lower()}") for p in ("1Y", "3Y", "5Y")))
    sharpe = risk.filter(F.col("period") == "3Y").select("scheme_code", F.col("sharpe").alias("sharpe_3y"))
    rank = ranks.filter(F.col("period") == "3Y").select("scheme_code", F.col("percentile").alias("percentile_3y"))
    bench = proxies.select("category", "proxy_scheme_code", "proxy_name", F.col("note").alias("proxy_note"))
    card = master
    for facts in (price, size, cost, rets, sharpe, rank):
        card = card.join(facts, "scheme_code", "left")
    return card.join(bench, "category", "left")


def filter_schemes(card: DataFrame, q: str | None = None, category: str | None = None, amc: str | None = None,
                   plan_type: str | None = None, option_type: str | None = None) -> DataFrame:
    """Usable schemes that match; ``q`` is a case-insensitive part of the name or
    house in which % and _ stand for any text and any character."""
    rows = usable(card)
    if q:
        pattern = f"%{q}%"
        rows = rows.filter(F.col("name").ilike(pattern) | F.col("amc").ilike(pattern))
    for column, value in (("category", category), ("amc", amc), ("plan_type", plan_type), ("option_type", option_type)):
        if value:
            rows = rows.filter(F.col(column) == value)
    return rows


def match_count(card: DataFrame, **filters: str | None) -> DataFrame:
    return filter_schemes(card, **filters).agg(F.count(F.lit(1)).alias("total"))


def listing_order(sort: str = "3Y", descending: bool = True) -> list[Column]:
    """Nulls last either way, ties by name and code."""
    if sort not in _SORTS:
        raise ValueError(f"unknown sort {sort!r}")
    key = F.col(_SORTS[sort])
    return [key.desc_nulls_last() if descending else key.asc_nulls_last(), F.asc("name"), F.asc("scheme_code")]


def listing(card: DataFrame, **filters: str | None) -> DataFrame:
    """The rows of the listing, in no order."""
    rows = filter_schemes(card, **filters).select(
        "scheme_code", "name", "amc", "category", "plan_type", "option_type", "nav", "nav_date",
        "ret_1y", "ret_3y", "ret_5y", "sharpe_3y", "percentile_3y",
        top_share_label(F.col("percentile_3y")).alias("top_share_3y"), "aaum_cr")
    return rows.withColumn("top_share_3y", F.when(F.col("percentile_3y").isNotNull(), F.col("top_share_3y")))


def explorer_page(card: DataFrame, sort: str = "3Y", descending: bool = True, page: int = 1, page_size: int = 50,
                  **filters: str | None) -> DataFrame:
    """One page of the listing. Many pages of one order are cheaper from ``paging``."""
    return listing(card, **filters).orderBy(*listing_order(sort, descending)).offset((page - 1) * page_size).limit(page_size)


def scheme_detail(card: DataFrame) -> DataFrame:
    """The card with the explanation of its quality flag and its percentile band.
    Flagged schemes stay visible here."""
    label, text = quality_note(F.col("data_quality"), F.col("nav_date"))
    return card.withColumns({"quality_label": label, "quality_text": text, "band_3y": percentile_band(F.col("percentile_3y"))})


def period_rows(master: DataFrame, returns: DataFrame, stats: DataFrame, proxies: DataFrame) -> DataFrame:
    """Return of every scheme and period beside its benchmark's and its category's
    average."""
    bench = returns.select(F.col("scheme_code").alias("proxy_scheme_code"), "period", F.col("ret").alias("benchmark_return"))
    average = stats.select("category", "period", F.col("avg_return").alias("category_avg_return"))
    dims = master.select("scheme_code", "category").join(proxies.select("category", "proxy_scheme_code"), "category", "left")
    linked = bench.join(proxies.select("proxy_scheme_code").distinct(), "proxy_scheme_code", "left_semi")
    return (returns.join(dims, "scheme_code").join(linked, ["proxy_scheme_code", "period"], "left")
            .join(average, ["category", "period"], "left")
            .select("scheme_code", "period", period_position(F.col("period")).alias("position"),
                    F.col("ret").alias("fund_return"), "benchmark_return", "category_avg_return"))


def facets(master: DataFrame) -> DataFrame:
    """(facet, value, count) over usable schemes, categories and houses counted in
    one pass, sorted by value."""
    rows = usable(master).select(F.explode(F.array(
        F.struct(F.lit("category").alias("facet"), F.col("category").alias("value")),
        F.struct(F.lit("amc").alias("facet"), F.col("amc").alias("value")))).alias("f")).select("f.*")
    return (rows.filter(F.col("value").isNotNull()).groupBy("facet", "value")
                .agg(F.count(F.lit(1)).alias("count")).orderBy("facet", "value"))


def chart_points(nav: DataFrame, max_points: int = K.MAX_CHART_POINTS) -> DataFrame:
    """(scheme_code, range, date, nav): the last 1, 3, 5 years and all of a series,
    thinned newest first so that the latest price stays. All ranges share one
    numbering, since each is a tail of the series."""
    group = Window.partitionBy("scheme_code")
    rows = (nav.withColumn("latest", F.max("date").over(group))
               .withColumn("i", F.row_number().over(group.orderBy(F.desc("date"))) - 1))

    def inside(days: int | None) -> Column:
        return F.lit(True) if days is None else F.col("date") >= F.date_sub("latest", days)

    for name, days in K.CHART_RANGE_DAYS.items():
        n = F.count(F.when(inside(days), 1)).over(group)
        rows = rows.withColumn(f"stride{name}", F.greatest(F.lit(1), F.ceil(n / max_points)))
    kept = F.filter(F.array(*(F.when(inside(days) & (F.col("i") % F.col(f"stride{name}") == 0), F.lit(name))
                              for name, days in K.CHART_RANGE_DAYS.items())), lambda r: r.isNotNull())
    return rows.select("scheme_code", F.explode(kept).alias("range"), "date", "nav")


def holdings_top(holdings: DataFrame, limit: int = 25) -> DataFrame:
    """The largest positions of every scheme's newest portfolio."""
    return top_k(latest_holdings(holdings), ["scheme_code"],
                 [F.desc_nulls_last("pct_of_aum"), F.asc("isin")], limit).select(
        "scheme_code", "as_of_date", "rank", "isin", "instrument_name", "sector", "pct_of_aum", "market_value_cr")


def sectors_ranked(sectors: DataFrame) -> DataFrame:
    """Sectors of the newest portfolio of every scheme, largest first."""
    order = Window.partitionBy("scheme_code").orderBy(F.desc_nulls_last("pct_of_aum"), F.asc("sector"))
    return latest_holdings(sectors).withColumn("rank", F.row_number().over(order))


def freshness(nav: DataFrame, holdings: DataFrame, costs: DataFrame, as_of: str) -> DataFrame:
    """Newest date, age and staleness of each source; a source without rows is
    stale."""
    newest = (nav.agg(F.lit("nav").alias("source"), F.max("date").alias("latest"))
              .unionByName(holdings.agg(F.lit("holdings").alias("source"), F.max("as_of_date").alias("latest")))
              .unionByName(costs.agg(F.lit("costs").alias("source"), F.max("as_of_date").alias("latest"))))
    limit = F.element_at(F.create_map(*(F.lit(x) for kv in K.FRESHNESS_DAYS.items() for x in kv)), F.col("source"))
    age = F.datediff(F.lit(as_of).cast("date"), "latest")
    return newest.select("source", "latest", age.alias("age_days"), F.coalesce(age > limit, F.lit(True)).alias("stale"),
                         limit.alias("stale_after_days"))
