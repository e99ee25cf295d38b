"""The registered queries: library jobs over the derived model tables."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navloom import schemas
from navloom.functions import feeds, names, tax
from navloom.functions.rounding import rnd
from navloom.operators import merge, resolve, series
from navloom.plans import (alike, backtest, compare, costleak, explorer, nightly, overlap, paging, projections, quality, returns,
                           risk, rolling, search, upkeep)
from navloom.plans import tax as plan_taxes
from navloom.session import scratch_dir, settle, settle_by, shuffle_partitions
from navloom.sources import benchmark, costs, holdings, master, nav_text, prices, sheets
from navloom.streaming import ingest
from workload.views import AS_OF, SHEETS_READ_ON, view

OVERLAP_SHOWN = 2.0  # per cent, for the query over all pairs

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(run: Query) -> Query:
    REGISTRY[run.__name__] = run
    return run


class Tables:
    """The model tables of one data folder, and the metric tables over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, f"fx_{name}")

    def stored_nav(self) -> DataFrame:
        """The price series in the layout for jobs that read it several times."""
        return prices.by_scheme(self.nav)

    def stored_master(self) -> DataFrame:
        return settle(self.master, "master")

    def stored_holdings(self) -> DataFrame:
        return settle(self.holdings, "holdings")

    def stored_weights(self) -> DataFrame:
        """The holdings without text, for jobs that read weights only."""
        return settle(self.holdings.select("scheme_code", "as_of_date", "isin", "pct_of_aum"), "holdings")

    @property
    def proxies(self) -> DataFrame:
        return benchmark.benchmark_proxies(self.spark)

    def metrics(self, nav: DataFrame) -> dict[str, DataFrame]:
        save = nightly.table_saver(self.spark, scratch_dir(self.spark, "metrics"))
        return nightly.metric_tables(nav, self.stored_master(), self.proxies, AS_OF, save)


@query
def plan_projections(spark, sf_dir):
    return projections.project_plans(Tables(spark, sf_dir).scenarios)


# --- metric tables ---------------------------------------------------------------

@query
def scheme_returns(spark, sf_dir):
    return returns.scheme_returns(Tables(spark, sf_dir).nav)


@query
def scheme_risk(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return risk.scheme_risk(t.stored_nav(), t.stored_master(), t.proxies, AS_OF)


@query
def quality_flags(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return quality.quality_flags(t.master, t.nav, AS_OF)


@query
def price_jumps(spark, sf_dir):
    return (series.with_jumps(Tables(spark, sf_dir).nav).groupBy("scheme_code")
            .agg(F.max("jumps").alias("jumps"), F.min(F.when(F.col("jumps") > 0, F.col("date"))).alias("first_jump")))


@query
def category_stats(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.metrics(t.stored_nav())["category_stats"]


@query
def rankings(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.metrics(t.stored_nav())["rankings"]


@query
def rolling_stats(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return rolling.rolling_stats(t.stored_nav(), t.stored_master(), t.proxies)


@query
def rolling_points(spark, sf_dir):
    return rolling.rolling_points(Tables(spark, sf_dir).nav)


@query
def nightly_rebuild(spark, sf_dir):
    """All metric tables written to files; the rows of each, and a sum over its rounded values."""
    t = Tables(spark, sf_dir)
    tables = nightly.rebuild(spark, t.stored_nav(), t.stored_master(), t.proxies, AS_OF, scratch_dir(spark, "nightly"))

    def hundredths(*columns):
        return reduce(lambda a, b: a + b, [F.coalesce(F.round(F.col(c) * 100), F.lit(0.0)).cast("bigint") for c in columns])

    flag = F.col("data_quality")
    values = {"scheme_returns": hundredths("ret"), "scheme_risk": hundredths("stdev", "sharpe", "beta", "alpha", "max_drawdown"),
              "scheme_master": F.when(flag == "stale", 1).when(flag == "discontinuity", 1000).otherwise(0).cast("bigint"),
              "category_stats": hundredths("avg_return", "median_return") + F.col("scheme_count"),
              "rankings": F.col("rank_in_category") + 7 * F.col("category_size") + F.col("percentile").cast("bigint")}
    counts = [table.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"), F.sum(values[name]).alias("value_sum")) for name, table in tables.items()]
    return reduce(DataFrame.unionByName, counts)


@query
def kept_tables(spark, sf_dir):
    """Returns and risk kept up over two batches: a history without its newest days and with wrong prices, and what puts
    it right, benchmarks among it."""
    t = Tables(spark, sf_dir)
    nav, master_rows = settle(t.nav, "nav"), t.stored_master()
    store, state = scratch_dir(spark, "kept-prices"), scratch_dir(spark, "kept-state")
    late, wrong = F.col("date") >= "2001-08-20", F.col("date").between("2000-03-05", "2000-04-11") & (F.crc32("scheme_code") % 3 == 0)
    first = nav.filter(~late).withColumn("nav", F.when(wrong, F.col("nav") * 1.7).otherwise(F.col("nav")))
    for batch in (first, nav.filter(late | wrong)):
        upkeep.ingest(spark, store, state, batch, master_rows, t.proxies, AS_OF)
    kept = upkeep.scheme_returns(spark, state).withColumnRenamed("as_of_date", "latest")
    return kept.join(upkeep.scheme_risk(spark, state), ["scheme_code", "period"], "full_outer")


# --- portfolios ---------------------------------------------------------------------

@query
def overlap_pairs(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return overlap.overlap_pairs(overlap.anchored_pairs(t.sets).select("a", "b").distinct(), t.stored_weights())


@query
def overlap_top_common(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return overlap.top_common(overlap.anchored_pairs(t.sets), t.stored_holdings())

@query
def set_overlaps(spark, sf_dir):
    """The overlap of every fund of every set with the set's first fund."""
    t = Tables(spark, sf_dir)
    return overlap.overlap_pairs(overlap.anchored_pairs(t.sets), t.stored_weights())


@query
def overlap_above(spark, sf_dir):
    """Every pair of all funds' newest portfolios that share two per cent or more."""
    newest = overlap.latest_holdings(Tables(spark, sf_dir).stored_holdings())
    return alike.overlap_above(overlap.newest_weights(newest), OVERLAP_SHOWN)


@query
def portfolio_classes(spark, sf_dir):
    newest = overlap.latest_holdings(Tables(spark, sf_dir).stored_holdings())
    return alike.portfolio_classes(overlap.newest_weights(newest))


@query
def combined_exposure(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return overlap.combined_exposure(t.sets, t.stored_holdings())


@query
def set_concentration(spark, sf_dir):
    t = Tables(spark, sf_dir)
    sets, disclosed = settle(t.sets, "sets"), t.stored_holdings()
    return (overlap.concentration(overlap.combined_exposure(sets, disclosed))
            .join(overlap.set_freshness(sets, disclosed), "set_id"))


@query
def rejected_sets(spark, sf_dir):
    return overlap.rejected_sets(Tables(spark, sf_dir).sets)


@query
def covered_weight(spark, sf_dir):
    return overlap.covered_weight(overlap.portfolio_weights(overlap.latest_holdings(Tables(spark, sf_dir).holdings)))


@query
def holdings_top(spark, sf_dir):
    return explorer.holdings_top(Tables(spark, sf_dir).holdings)


@query
def sector_allocation(spark, sf_dir):
    return explorer.sectors_ranked(holdings.sector_rows(Tables(spark, sf_dir).holdings))


# --- cost leak, backtests, tax, projections -------------------------------------------

@query
def cost_leak(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return costleak.cost_leak(t.stored_master(), t.stored_nav(), t.costs)


@query
def cost_leak_3y(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return costleak.cost_leak(t.stored_master(), t.stored_nav(), t.costs, amount=100_000.0, years=3)


@query
def unlinked_plans(spark, sf_dir):
    """The fund group is taken from plans whose group has no Direct and Regular pair; they are then linked to nothing."""
    t = Tables(spark, sf_dir)
    pairs = costleak.plan_twins(t.master).filter("direct_code IS NOT NULL AND regular_code IS NOT NULL").select("fund_group_id", F.lit(True).alias("paired")).distinct()
    linked = t.master.join(pairs, "fund_group_id", "left").withColumn("fund_group_id", F.when(F.col("paired"), F.col("fund_group_id")))
    return costleak.unlinked_plans(linked)


@query
def backtest_validity(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return backtest.plan_validity(t.plans, t.master, t.nav)


def _buys(t: Tables) -> DataFrame:
    nav = t.stored_nav()
    return backtest.sip_buys(backtest.valid_plans(t.plans, t.stored_master(), nav), nav)


def _plan_summary(t: Tables) -> DataFrame:
    nav = t.stored_nav()
    return backtest.plan_summary(backtest.valid_plans(t.plans, t.stored_master(), nav), nav)


@query
def sip_summary(spark, sf_dir):
    return _plan_summary(Tables(spark, sf_dir))


@query
def sip_series(spark, sf_dir):
    return backtest.sip_series(_buys(Tables(spark, sf_dir)))


@query
def sip_xirr(spark, sf_dir):
    return backtest.sip_xirr(_buys(Tables(spark, sf_dir)))


@query
def lumpsum_summary(spark, sf_dir):
    t = Tables(spark, sf_dir)
    nav = t.stored_nav()
    return backtest.lumpsum_summary(backtest.valid_plans(t.plans, t.stored_master(), nav), nav)


@query
def lumpsum_series(spark, sf_dir):
    t = Tables(spark, sf_dir)
    nav = t.stored_nav()
    return backtest.lumpsum_series(backtest.valid_plans(t.plans, t.stored_master(), nav), nav)


@query
def sip_tax(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return plan_taxes.plan_tax(_plan_summary(t), t.plans, t.master)


@query
def lumpsum_tax(spark, sf_dir):
    t = Tables(spark, sf_dir)
    nav = t.stored_nav()
    summary = backtest.lumpsum_summary(backtest.valid_plans(t.plans, t.stored_master(), nav), nav)
    return plan_taxes.plan_tax(summary, t.plans, t.master)


@query
def tax_classes(spark, sf_dir):
    return Tables(spark, sf_dir).catalog.groupBy(tax.tax_class(F.col("category"), F.col("name")).alias("tax_class"), "category").agg(
        F.count(F.lit(1)).alias("schemes"))


@query
def withdrawal_summary(spark, sf_dir):
    return projections.withdrawal_summary(Tables(spark, sf_dir).scenarios)


@query
def withdrawal_schedule(spark, sf_dir):
    return projections.withdrawal_schedule(Tables(spark, sf_dir).scenarios)


# --- listing ------------------------------------------------------------------------

def _card(t: Tables) -> DataFrame:
    nav = t.stored_nav()
    m = t.metrics(nav)
    return explorer.scheme_card(m["scheme_master"], nav, m["scheme_returns"], m["scheme_risk"], m["rankings"],
                                t.costs, t.aum, t.proxies)


@query
def explorer_page(spark, sf_dir):
    return explorer.explorer_page(_card(Tables(spark, sf_dir)))


@query
def explorer_late_page(spark, sf_dir):
    """A late page by name from the stored order, whose parts are small here so that the page lies in some of several."""
    path, order = scratch_dir(spark, "listing-order"), explorer.listing_order("name", descending=False)
    paging.write_order(explorer.listing(_card(Tables(spark, sf_dir))), order, path, part_rows=40)
    return paging.page(spark, path, order, number=5, size=25)


@query
def explorer_search(spark, sf_dir):
    """Through the trigram index, which gives the candidates for the pattern."""
    t, index = Tables(spark, sf_dir), scratch_dir(spark, "name-index")
    search.write_index(t.master, index)
    return explorer.explorer_page(search.narrowed(_card(t), index, "b_rch"), sort="nav", descending=False, page=2, page_size=20,
                                  q="b_rch", plan_type="Regular", option_type="Growth")


@query
def explorer_total(spark, sf_dir):
    t = Tables(spark, sf_dir)
    flagged = quality.with_quality(t.master, quality.quality_flags(t.master, t.nav, AS_OF))
    return explorer.match_count(flagged, q="brand", category="Equity Scheme - Mid Cap Fund")


@query
def scheme_detail(spark, sf_dir):
    return explorer.scheme_detail(_card(Tables(spark, sf_dir)))


@query
def period_rows(spark, sf_dir):
    t = Tables(spark, sf_dir)
    m = t.metrics(t.stored_nav())
    return explorer.period_rows(m["scheme_master"], m["scheme_returns"], m["category_stats"], t.proxies)


@query
def chart_points(spark, sf_dir):
    return explorer.chart_points(Tables(spark, sf_dir).nav)


@query
def compare_best(spark, sf_dir):
    t = Tables(spark, sf_dir)
    m = t.metrics(t.stored_nav())
    return compare.compare_best(t.compare, m["scheme_returns"], m["scheme_risk"])


@query
def compare_table(spark, sf_dir):
    t = Tables(spark, sf_dir)
    m = t.metrics(t.stored_nav())
    return compare.compare_table(t.compare, m["scheme_master"], m["scheme_returns"], m["category_stats"], m["scheme_risk"], t.proxies)


@query
def facets(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return explorer.facets(quality.with_quality(t.master, quality.quality_flags(t.master, t.nav, AS_OF)))


@query
def freshness(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return explorer.freshness(t.nav, t.holdings, t.costs, AS_OF)


@query
def benchmark_map(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return (t.catalog.join(t.proxies, "category", "left").groupBy("category", "proxy_scheme_code", "proxy_name")
            .agg(F.count(F.lit(1)).alias("schemes")))


@query
def benchmark_seed(spark, sf_dir):
    """The fixed benchmark rows written over what is stored for every category."""
    t = Tables(spark, sf_dir)
    stored = t.catalog.select("category", F.lit("0").alias("proxy_scheme_code"), F.lit("old").alias("proxy_name"), F.lit("old").alias("note")).distinct()
    return benchmark.seed(stored, spark)


# --- names and feeds -------------------------------------------------------------------

@query
def name_functions(spark, sf_dir):
    name, amc = F.col("name"), F.col("amc")
    return Tables(spark, sf_dir).catalog.select(
        "scheme_code", names.plan_type(name).alias("plan_type"), names.option_type(name).alias("option_type"),
        names.fund_group_id(amc, name).alias("fund_group_id"), names.sub_category(F.col("category")).alias("sub_category"),
        names.name_tokens(name).alias("tokens"), names.master_identity(name).alias("identity"),
        names.sheet_identity(name).alias("sheet_identity"), names.house_key(amc).alias("house_key"))


@query
def name_resolution(spark, sf_dir):
    t = Tables(spark, sf_dir)
    wanted = t.targets.select("amc", names.sheet_identity(F.col("title")).alias("target"))
    return resolve.resolve_names(wanted, t.catalog)


@query
def daily_file(spark, sf_dir):
    return nav_text.parse_lines(Tables(spark, sf_dir).lines)


@query
def landed_daily_file(spark, sf_dir):
    """The same lines written as text files and read back through the file source."""
    out = scratch_dir(spark, "daily-files")
    lines = Tables(spark, sf_dir).lines
    (lines.repartition("file").sortWithinPartitions("file", "pos").select("file", F.col("line").alias("value"))
          .write.partitionBy("file").text(out))
    return nav_text.parse_lines(nav_text.read_lines(spark, out)).select("scheme_code", "nav", "nav_date", "category", "amc")


@query
def daily_file_ingest(spark, sf_dir):
    """The same files streamed into a price store, then all of them again under a fresh checkpoint, which must change nothing."""
    store, landed = scratch_dir(spark, "daily-prices"), scratch_dir(spark, "daily-files")
    lines = Tables(spark, sf_dir).lines
    (lines.repartition("file").sortWithinPartitions("file", "pos").select("file", F.col("line").alias("value"))
          .write.partitionBy("file").text(landed))
    for _ in range(2):
        ingest.ingest_daily_files(spark, landed, store, scratch_dir(spark, "daily-checkpoint")).awaitTermination()
    return prices.read_prices(spark, store)


def _history_documents(t: Tables) -> DataFrame:
    """One JSON document per scheme and year, with some unreadable entries."""
    day = F.dayofmonth("date")
    entry = F.struct(F.when(day == 17, "bad").otherwise(F.date_format("date", "dd-MM-yyyy")).alias("date"),
                     F.when(day == 13, "N.A.").when(day == 29, "-5.0").otherwise(F.col("nav").cast("string")).alias("nav"))
    return t.nav.groupBy("scheme_code", F.year("date").alias("year")).agg(F.collect_list(entry).alias("data"))


@query
def history_json(spark, sf_dir):
    out = scratch_dir(spark, "history")
    _history_documents(Tables(spark, sf_dir)).select("scheme_code", "data").write.json(out)
    return prices.read_history(spark, out)


def _corrections(nav: DataFrame) -> DataFrame:
    """Today's file: corrected prices of the last quarter, and a price for today."""
    recent = nav.filter(F.col("date") >= "2001-08-01").select("scheme_code", "date", F.round(F.col("nav") * 2, 4).alias("nav"))
    today = nav.groupBy("scheme_code").agg(F.max_by("nav", "date").alias("nav")).select(
        "scheme_code", F.lit(AS_OF).cast("date").alias("date"), "nav")
    return recent.unionByName(today)


@query
def price_upsert(spark, sf_dir):
    nav = Tables(spark, sf_dir).nav
    return prices.upserted(nav, _corrections(nav))


@query
def price_backfill(spark, sf_dir):
    nav = Tables(spark, sf_dir).nav
    return prices.backfilled(nav.filter(F.col("date") >= "1998-01-01"), nav.withColumn("nav", F.round(F.col("nav") * 3, 4)))


@query
def price_store(spark, sf_dir):
    """Written by month, corrected in a new version, corrected again, read back."""
    nav = settle(Tables(spark, sf_dir).nav, "nav")
    store = scratch_dir(spark, "prices")
    prices.write_prices(nav, store)
    for _ in range(2):
        prices.merge_into_store(spark, store, _corrections(nav))
    return prices.read_prices(spark, store)


@query
def stream_ingest(spark, sf_dir):
    """Events as landed files, a batch each: one value per user and day, the last one wins.
    Then all of it again under a fresh checkpoint, which must change nothing."""
    store, landed = scratch_dir(spark, "stream-prices"), scratch_dir(spark, "events")
    spark.read.parquet(f"{sf_dir}/events.parquet").repartitionByRange(3, F.to_date("ts")).write.parquet(landed)
    schema = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"

    def daily(batch: DataFrame) -> DataFrame:
        last = F.max_by("value", F.struct("ts", "event_id"))
        return (batch.groupBy(F.concat(F.lit("U"), F.col("user_id")).alias("scheme_code"), F.to_date("ts").alias("date"))
                     .agg(last.alias("nav")))

    for files in (1, 1000):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(landed)
        ingest.ingest_available(stream, store, scratch_dir(spark, "stream-checkpoint"), daily).awaitTermination()
    return prices.read_prices(spark, store)


@query
def master_sync(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return master.synced(t.master_old, t.master_new, AS_OF)


@query
def pending_backfill(spark, sf_dir):
    stored = Tables(spark, sf_dir).stored_master()
    return merge.pending(stored.select("scheme_code", "plan_type"), stored, "scheme_code")


@query
def backfill_marks(spark, sf_dir):
    """A load of everything pending, marked on the master."""
    t = Tables(spark, sf_dir)
    stored = t.stored_master().withColumn("backfill_status", F.when(F.col("plan_type") == "Direct", F.col("backfill_status")))
    todo = merge.pending(stored.select("scheme_code"), stored, "scheme_code")
    marks = master.backfill_marks(todo, t.nav, AS_OF)
    return master.marked(stored.withColumn("backfill_date", F.lit(None).cast("date")), marks).select(
        "scheme_code", "backfill_status", "backfill_date")


@query
def ter_load(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return costs.upserted(t.costs, costs.ter_rows(t.ter, t.master, "2001-11-01"))


@query
def ter_report(spark, sf_dir):
    t = Tables(spark, sf_dir)
    unmapped = costs.unmapped_houses(t.ter, t.master).select(F.col("mf_name").alias("amc"), F.lit(None).cast("bigint").alias("unmatched"))
    return costs.ter_unmatched(t.ter, t.master).unionByName(unmapped)


def _size_groups(t: Tables) -> DataFrame:
    """The nested feed as landed JSON: a group holds a fund and its fund-of-funds
    sibling."""
    def entry(suffix: str, headline, fof):
        return F.struct(F.lit("n").alias("SchemeNAVName"), F.concat("code", F.lit(suffix)).alias("AMFI_Code"),
                        F.struct(headline.alias("ExcludingFundOfFundsDomesticButIncludingFundOfFundsOverseas"),
                                 fof.alias("FundOfFundsDomestic")).alias("AverageAumForTheMonth"))

    groups = t.sizes.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ordinal"), F.lit("House").alias("Mfname"), F.lit("Equity").alias("SchemeCat_Desc"),
                            F.array(entry("", F.col("headline"), F.col("fof")),
                                    entry("F", F.lit("0"), F.col("fof"))).alias("schemes"))
    out = scratch_dir(t.spark, "size-groups")
    groups.write.option("compression", "gzip").json(out)  # a file a part, and most of its text is field names
    return t.spark.read.schema(schemas.AUM_GROUPS).json(out)


@query
def aum_load(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return costs.known_aum(_size_groups(t), t.catalog, feeds.period_end(F.lit("October - December 2001")))


@query
def aum_upsert(spark, sf_dir):
    """The size feed merged into stored sizes, of which it has some."""
    t = Tables(spark, sf_dir)
    stored = t.catalog.select("scheme_code", F.when(F.col("p_size") <= 25, F.lit("2001-12-31")).otherwise(F.lit("2001-09-30")).cast("date").alias("as_of_date"),
                              F.col("p_retailprice").cast("double").alias("aaum_cr"), F.col("p_type").alias("source"))
    return costs.upserted(stored, costs.known_aum(_size_groups(t), t.catalog, "2001-12-31"))


@query
def aum_unknown(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return costs.unknown_aum(_size_groups(t), t.catalog)


@query
def period_ends(spark, sf_dir):
    """The end of every quarter with prices, read from the label a size feed gives it."""
    first = F.trunc("date", "quarter")
    label = F.concat(F.date_format(first, "MMMM"), F.lit(" - "), F.date_format(F.add_months(first, 2), "MMMM"), F.lit(" "), F.year("date").cast("string"))
    labels = Tables(spark, sf_dir).nav.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("prices"))
    return labels.withColumn("period_end", feeds.period_end(F.col("label")))


@query
def newest_links(spark, sf_dir):
    return holdings.newest_links(Tables(spark, sf_dir).links)


# --- portfolio sheets ----------------------------------------------------------------------

_LANDED_ROWS = 250_000  # holdings of a bucket of cells, about; a holding is seven cells


def _landed_cells(t: Tables, notes: bool = False) -> tuple[DataFrame, DataFrame]:
    """Every yearly portfolio laid out as a sheet in one of three house styles and
    landed as a table of cells, and the house of every file. Every tenth fund shows
    one position too many for its weights to add up, every other tenth has a name that
    no master fund has. With ``notes`` there are sheets beside the portfolios: notes without a table, tables
    without weights and tables without a line. Cells land in buckets of whole sheets."""
    k = F.substring("scheme_code", 2, 20).try_cast("bigint")
    lit, none = F.lit, F.lit(None)
    held, stored = t.stored_holdings(), t.stored_master().select("scheme_code", "name", "amc")

    def filed(portfolios: DataFrame, year) -> DataFrame:
        return portfolios.join(stored, "scheme_code").withColumn("file", F.concat(F.lower(F.split("amc", " ")[0]), lit("-"), year, lit(".xlsx")))

    rows = filed(held, F.year("as_of_date")).withColumn("style", k % 3)
    dated = filed(held.select("scheme_code", "as_of_date").distinct(), F.year("as_of_date"))

    def cell(row, col, value, num=none, dt=none):
        return F.struct(F.lit(row).cast("bigint").alias("row_idx") if isinstance(row, int) else row.alias("row_idx"),
                        lit(col).alias("col_idx"), F.lit(value).cast("string").alias("text") if isinstance(value, str)
                        else value.cast("string").alias("text"), num.cast("double").alias("num"), dt.cast("date").alias("dt"))

    def number(row, col, value):
        return cell(row, col, value, num=value)

    day = F.col("as_of_date")
    at = 8 + F.substring("isin", 3, 18).cast("bigint")
    fund, lakh, weight = F.col("fund"), F.col("market_value_cr") * 100, F.col("pct_of_aum")
    # label and date cell, percent weights
    title_a = F.array(
        cell(1, 0, F.col("amc")), cell(2, 0, "SCHEME NAME :"), cell(2, 1, fund),
        cell(3, 0, "PORTFOLIO STATEMENT AS ON"), cell(3, 1, day, dt=day),
        cell(5, 2, "Name of the Instrument / Issuer"), cell(5, 3, "ISIN"), cell(5, 4, "Rating / Industry^"), cell(5, 5, "Quantity"),
        cell(5, 6, "Market value (Rs. in Lakhs)"), cell(5, 7, "% to AUM"))
    row_a = F.array(
        cell(at, 2, F.concat("instrument_name", lit(" $$ ~~"))), cell(at, 3, F.col("isin")), cell(at, 4, F.col("sector")),
        number(at, 5, lit(100.0)), number(at, 6, lakh), number(at, 7, weight))
    # code in the first column, ISIN before the name, fraction weights
    title_b = F.array(
        cell(1, 0, "QX-77"), cell(1, 1, F.concat("fund", lit(" (An Open Ended Scheme)"))),
        cell(2, 1, F.concat(lit("Monthly Portfolio Statement as on "), F.date_format(day, "MMMM d,yyyy"))),
        cell(4, 1, "ISIN"), cell(4, 2, "Name of the Instrument"), cell(4, 3, "Industry / Rating"), cell(4, 4, "Quantity"),
        cell(4, 5, "Market/Fair Value ( Rs. in Lacs)"), cell(4, 6, "% to NAV"),
        cell(5, 1, "Sub Total"), number(5, 6, lit(0.3141)))
    row_b = F.array(
        cell(at, 0, "LN-9"), cell(at, 1, F.col("isin")), cell(at, 2, F.col("instrument_name")), cell(at, 3, F.col("sector")),
        number(at, 4, lit(7.0)), number(at, 5, lakh), number(at, 6, weight / 100))
    # title text, names beside the ISIN and not under their label
    title_c = F.array(
        cell(1, 2, F.concat(lit("Portfolio of "), "fund", lit(" as on "), F.date_format(day, "dd-MMM-yyyy"))),
        cell(2, 0, "Name of Instrument"), cell(2, 3, "ISIN Code"), cell(2, 4, "Industry"), cell(2, 5, "Yield"),
        cell(2, 6, "Quantity"), cell(2, 7, "Market Value (Rs.in Lacs)"), cell(2, 8, "% to Net Assets"))
    row_c = F.array(
        cell(at, 1, " "), cell(at, 2, F.col("instrument_name")), cell(at, 3, F.col("isin")), cell(at, 4, "CRISIL AAA"),
        number(at, 6, lit(9.0)), number(at, 7, lakh), number(at, 8, weight))

    def junk(name_col: int, isin_col: int, pct_col: int, value: float):
        return F.array(cell(6, name_col, "Double Ltd"), cell(6, isin_col, "INZZZZZZZZZ9"), number(6, pct_col, lit(value)))

    def by_style(a, b, c):
        return F.when(F.col("style") == 0, a).when(F.col("style") == 1, b).otherwise(c)

    fund_name = F.regexp_replace("name", " - Regular Plan - Growth$", "")
    titles = settle(dated.select("file", "scheme_code", (k % 3).alias("style"), F.when(k % 10 == 4, F.concat(lit("Unlisted "), fund_name)).otherwise(fund_name).alias("fund"),
                                 "as_of_date", "amc").distinct(), "titles")
    top = by_style(title_a, title_b, title_c)
    top = F.when(k % 10 == 9, F.concat(top, by_style(junk(2, 3, 7, 30.0), junk(2, 1, 6, 0.3), junk(2, 3, 8, 30.0)))).otherwise(top)
    partitions = shuffle_partitions(t.spark)
    buckets = partitions * math.ceil(held.count() / (_LANDED_ROWS * partitions) or 1)

    def cells(source: DataFrame, packed) -> DataFrame:
        # rows move to their bucket before each becomes its cells, and a sheet's lie together
        placed = source.repartition(buckets, "file", "scheme_code").sortWithinPartitions("file", "scheme_code")
        return placed.select("file", F.col("scheme_code").alias("sheet"), F.explode(packed).alias("c")).select("file", "sheet", "c.*")

    body = rows.select("file", "scheme_code", "style", "instrument_name", "isin", "sector", "pct_of_aum", "market_value_cr")
    landed = cells(titles, top).unionByName(cells(body, by_style(row_a, row_b, row_c)))
    if notes:
        beside = cells(_notes(filed(held.select("scheme_code", F.year("as_of_date").alias("year")).distinct(), F.col("year"))), F.col("packed"))
        landed = landed.unionByName(beside.withColumns({"num": none.cast("double"), "dt": none.cast("date")}))
    return settle_by(landed, "cells", "file", "sheet", buckets=buckets, placed=True), titles.select("file", "amc").distinct()


def _notes(held: DataFrame) -> DataFrame:
    """(file, scheme_code, packed): sheets without a portfolio, beside those of a file."""
    k = F.substring("scheme_code", 2, 20).try_cast("bigint") % 10
    labels = ["Name of the Instrument", "ISIN", "% to NAV"]

    def row(texts):
        return [F.struct(F.lit(4).cast("bigint").alias("row_idx"), F.lit(i).alias("col_idx"), F.lit(text).alias("text")) for i, text in enumerate(texts)]

    title = F.struct(F.lit(1).cast("bigint").alias("row_idx"), F.lit(0).alias("col_idx"), F.concat(F.lit("Portfolio of "), F.regexp_replace("name", " - .*", "")).alias("text"))
    extra = F.when(k == 2, F.array(title)).when(k == 3, F.array(title, *row(labels[:2]))).when(k == 5, F.array(title, *row(labels)))
    return held.select("file", F.concat("scheme_code", F.lit("-note")).alias("scheme_code"), extra.alias("packed"))


@query
def sheet_holdings(spark, sf_dir):
    t = Tables(spark, sf_dir)
    cells, houses = _landed_cells(t)
    parsed, lines = sheets.parse_sheets(cells, SHEETS_READ_ON)
    return holdings.holding_rows(lines, holdings.matched_sheets(parsed, houses, t.master))


@query
def sheet_sectors(spark, sf_dir):
    t = Tables(spark, sf_dir)
    cells, houses = _landed_cells(t)
    parsed, lines = sheets.parse_sheets(cells, SHEETS_READ_ON)
    return holdings.sector_rows(holdings.holding_rows(lines, holdings.matched_sheets(parsed, houses, t.master)))


@query
def sheet_suspects(spark, sf_dir):
    cells, _ = _landed_cells(Tables(spark, sf_dir))
    suspects = sheets.suspect(sheets.parse_sheets(cells, SHEETS_READ_ON)[0])
    return suspects.select("file", "sheet", "scheme_name", "as_of_date", F.round("total_pct", 2).alias("total_pct"))


@query
def sheet_report(spark, sf_dir):
    t = Tables(spark, sf_dir)
    cells, houses = _landed_cells(t)
    return holdings.load_report(sheets.parse_sheets(cells, SHEETS_READ_ON)[0], houses, t.master)


@query
def sheet_quarantine(spark, sf_dir):
    """Every landed sheet that gives no holdings, and why. Beside the portfolios there are notes without a table, tables
    without weights and tables without a line."""
    t = Tables(spark, sf_dir)
    cells, houses = _landed_cells(t, notes=True)
    return holdings.load_sheets(cells, houses, t.stored_master(), SHEETS_READ_ON).quarantine


@query
def holdings_replace(spark, sf_dir):
    """Last year's portfolios disclosed again with halved weights, twice, in a store."""
    stored = Tables(spark, sf_dir).stored_holdings()
    store = scratch_dir(spark, "holdings-store")
    holdings.write_holdings(stored, store)
    again = (stored.filter(F.year("as_of_date") == 2001).filter(F.col("sector") != "ECONOMY")
             .withColumn("pct_of_aum", rnd(F.col("pct_of_aum") / 2, 4)))
    for _ in range(2):
        holdings.replace_in_store(store, again)
    return holdings.read_holdings(spark, store)


@query
def pinned_prices(spark, sf_dir):
    """What a reader that pinned the store before two corrections sees after them."""
    nav = settle(Tables(spark, sf_dir).nav, "nav")
    store = scratch_dir(spark, "pinned-prices")
    pinned = prices.write_prices(nav, store)
    before = prices.read_prices(spark, store, version=pinned)
    for _ in range(2):
        prices.merge_into_store(spark, store, _corrections(nav))
    return before
