"""Holdings and sector tables from parsed sheets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from navloom import constants as K
from navloom import schemas
from navloom.functions.feeds import link_date
from navloom.functions.names import sheet_identity
from navloom.functions.rounding import rnd
from navloom.operators.merge import replace_groups
from navloom.operators.resolve import resolve_codes
from navloom.session import settle
from navloom.sources import sheets as sheet_source
from navloom.sources import versions

PORTFOLIO = ["scheme_code", "as_of_date"]
_COLUMNS = [*PORTFOLIO, "instrument_name", "isin", "sector", "pct_of_aum", "market_value_cr"]


def matched_sheets(sheets: DataFrame, houses: DataFrame, master: DataFrame) -> DataFrame:
    """(file, sheet, amc, scheme_code, as_of_date) of plausible sheets, one row per
    plan and option code of the fund; ``houses`` maps file to amc. Of two sheets
    for one portfolio the later file and sheet stays."""
    titled = (sheet_source.plausible(sheets).join(houses, "file")
              .withColumn("target", sheet_identity(F.col("scheme_name"))))
    codes = resolve_codes(titled, master).select("amc", "target", "scheme_code")
    source = F.max(F.struct("file", "sheet", "amc")).alias("s")
    return titled.join(codes, ["amc", "target"]).groupBy(*PORTFOLIO).agg(source).select("s.*", *PORTFOLIO)


def holding_rows(lines: DataFrame, matched: DataFrame) -> DataFrame:
    return lines.join(matched.hint("shuffle_hash"), sheet_source.SHEET).select(*_COLUMNS)


def sector_rows(holdings: DataFrame) -> DataFrame:
    """Weight per sector of every portfolio."""
    return holdings.groupBy(*PORTFOLIO, "sector").agg(rnd(F.sum(F.coalesce("pct_of_aum", F.lit(0.0))), 4).alias("pct_of_aum"))


def replaced(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """A new portfolio replaces the stored one of the same scheme and date whole."""
    return replace_groups(existing, incoming, PORTFOLIO)


_DATE = "CAST(as_of_date AS STRING)"
_ORDER = ["scheme_code", "isin"]


def read_holdings(spark: SparkSession, path: str, version: versions.Version | None = None, dates: list[str] | None = None) -> DataFrame:
    """Stored portfolios of the newest version or of one that was pinned, of the given dates (yyyy-mm-dd) only."""
    return versions.read(spark, path, schemas.HOLDINGS, version, dates)


def write_holdings(holdings: DataFrame, path: str) -> versions.Version:
    """Makes the portfolios that have a date the store's next version."""
    return versions.replace(holdings.select(*_COLUMNS).filter(F.col("as_of_date").isNotNull()), path, _DATE, _ORDER)


def replace_in_store(path: str, incoming: DataFrame) -> versions.Version:
    """Replaces the portfolios that ``incoming`` has, in a new version that rewrites their dates only. Doing so
    again changes nothing; a replacement that died leaves the last version."""
    return versions.merge(incoming.select(*_COLUMNS), path, schemas.HOLDINGS, _DATE, _ORDER, replaced)


def load_report(sheets: DataFrame, houses: DataFrame, master: DataFrame) -> DataFrame:
    """(amc, sheets, suspect, matched, unmatched) per house."""
    titled = sheets.join(houses, "file").withColumn("target", sheet_identity(F.col("scheme_name")))
    hits = resolve_codes(titled, master).select("amc", "target").distinct().withColumn("hit", F.lit(True))
    bad = F.col("total_pct") > K.MAX_PORTFOLIO_WEIGHT
    hit = F.col("hit").isNotNull()

    def tally(condition: Column) -> Column:
        return F.sum(F.when(condition, 1).otherwise(0))

    return titled.join(hits, ["amc", "target"], "left").groupBy("amc").agg(
        F.count(F.lit(1)).alias("sheets"), tally(bad).alias("suspect"),
        tally(~bad & hit).alias("matched"), tally(~bad & ~hit).alias("unmatched"))


REASONS = ["no header row", "header lacks a column", "no valid line", "no scheme name", "unknown house", "suspect weights", "no such fund", "superseded"]


@dataclass(frozen=True)
class Load:
    """What a load makes of the landed sheets: holding rows, (file, sheet, reason) of those held back, and how many were
    landed, loaded and held back for each reason."""
    rows: DataFrame
    quarantine: DataFrame
    counts: dict[str, int]


def load_sheets(cells: DataFrame, houses: DataFrame, master: DataFrame, as_of: str) -> Load:
    """Parses and matches all landed sheets. Every one of them either gives rows or is in the quarantine with the first
    reason that holds it back; the counters are taken in the job that writes these verdicts. ``houses`` has one row per
    file. A sheet whose every portfolio a later sheet gives is superseded."""
    parsed, lines = sheet_source.parse_sheets(cells, as_of)
    matched = settle(matched_sheets(parsed, houses, master), "matched")
    titled = parsed.select("file", "sheet", "total_pct", sheet_identity(F.col("scheme_name")).alias("target")).join(houses, "file", "left")
    known = resolve_codes(titled.filter(F.col("amc").isNotNull()), master).select("amc", "target").distinct().withColumn("known", F.lit(True))
    used = matched.select("file", "sheet").distinct().withColumn("used", F.lit(True))
    reason = (F.when(F.col("amc").isNull(), "unknown house").when(F.col("total_pct") > K.MAX_PORTFOLIO_WEIGHT, "suspect weights")
               .when(F.col("known").isNull(), "no such fund").when(F.col("used").isNull(), "superseded"))
    judged = titled.join(known, ["amc", "target"], "left").join(used, ["file", "sheet"], "left").select("file", "sheet", reason.alias("reason"))
    seen = Observation("sheets")
    counters = [F.count(F.lit(1)).alias("landed"), F.count(F.when(F.col("reason").isNull(), 1)).alias("loaded"),
                *(F.count(F.when(F.col("reason") == r, 1)).alias(r) for r in REASONS)]
    verdicts = settle(judged.unionByName(sheet_source.unparsed(cells, parsed, lines)).observe(seen, *counters), "verdicts")
    return Load(holding_rows(lines, matched), verdicts.filter(F.col("reason").isNotNull()), dict(seen.get))


def newest_links(links: DataFrame) -> DataFrame:
    """(amc, url) -> the newest dated workbook link of every house; links without a
    date are left out."""
    # null dates compare lowest; testing for them here would parse every link twice
    newest = F.max(F.struct(link_date(F.col("url")).alias("link_date"), "url")).alias("l")
    return links.groupBy("amc").agg(newest).select("amc", "l.link_date", "l.url").filter(F.col("link_date").isNotNull())
