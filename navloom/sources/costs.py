"""Expense-ratio and fund-size feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navloom.functions.feeds import lakh_to_crore, let, plausible_ter
from navloom.functions.names import house_key, sheet_identity, strip
from navloom.operators.merge import upserted_columns
from navloom.operators.resolve import resolve_codes
from navloom.session import settle


def latest_ter(records: DataFrame) -> DataFrame:
    """One row per house and scheme name of (mf_name, ordinal, Scheme_Name, R_TER,
    D_TER, TER_Date): the newest date wins, the earlier record on equal dates; a
    bad date is older than any."""
    date = F.coalesce(F.substring("TER_Date", 1, 10).try_cast("date"), F.lit("0001-01-01").cast("date"))
    named = records.withColumn("scheme_name", strip(F.coalesce("Scheme_Name", F.lit("")))).filter(F.col("scheme_name") != "")
    newest = F.max_by(F.struct(plausible_ter(F.col("R_TER")).alias("r_ter"), plausible_ter(F.col("D_TER")).alias("d_ter")),
                      F.struct(date.alias("d"), (-F.col("ordinal")).alias("o")))
    return (named.groupBy("mf_name", "scheme_name").agg(newest.alias("t"), F.max(date).alias("ter_date"))
                 .select("mf_name", "scheme_name", "t.r_ter", "t.d_ter", "ter_date"))


def house_names(master: DataFrame) -> DataFrame:
    """(key, amc): one master house per matching key."""
    houses = master.filter(F.col("amc").isNotNull()).select("amc").distinct()
    return houses.groupBy(house_key(F.col("amc")).alias("key")).agg(F.max("amc").alias("amc"))


def unmapped_houses(records: DataFrame, master: DataFrame) -> DataFrame:
    return (records.select("mf_name").distinct().withColumn("key", house_key(F.col("mf_name")))
                   .join(house_names(master), "key", "left_anti").select("mf_name"))


def _house_targets(records: DataFrame, master: DataFrame) -> DataFrame:
    named = (latest_ter(records).withColumn("key", house_key(F.col("mf_name")))
             .join(house_names(master), "key").withColumn("target", sheet_identity(F.col("scheme_name"))))
    return settle(named, "ter-targets")


def ter_rows(records: DataFrame, master: DataFrame, as_of: str) -> DataFrame:
    """(scheme_code, as_of_date, ter) for every plan of every fund a record
    resolves to; Direct plans take the direct ratio, all others the regular one."""
    named = _house_targets(records, master)
    codes = resolve_codes(named, master).join(master.select("scheme_code", "plan_type"), "scheme_code")
    ter = F.when(F.col("plan_type") == "Direct", F.col("d_ter")).otherwise(F.col("r_ter"))
    return (named.join(codes, ["amc", "target"]).withColumn("ter", ter).filter(F.col("ter").isNotNull())
                 .groupBy("scheme_code").agg(F.max_by("ter", F.struct("ter_date", "scheme_name")).alias("ter"))
                 .select("scheme_code", F.lit(as_of).cast("date").alias("as_of_date"), "ter"))


def ter_unmatched(records: DataFrame, master: DataFrame) -> DataFrame:
    """(amc, unmatched) scheme names per house that resolve to no fund."""
    named = _house_targets(records, master)
    matched = resolve_codes(named, master).select("amc", "target").distinct()
    return named.join(matched, ["amc", "target"], "left_anti").groupBy("amc").agg(F.count(F.lit(1)).alias("unmatched"))


def aum_rows(groups: DataFrame) -> DataFrame:
    """(scheme_code, aaum_cr, place) of landed size groups: the headline figure, or the
    domestic fund-of-funds one where that is empty or zero; ``place`` is the row's
    place in the feed."""
    headline = "s.AverageAumForTheMonth.ExcludingFundOfFundsDomesticButIncludingFundOfFundsOverseas"
    schemes = groups.select("ordinal", F.posexplode("schemes").alias("i", "s"))

    def size(column: str) -> Column:
        return let(lakh_to_crore(F.col(column)), lambda crore: F.nullif(crore, F.lit(0.0)))

    return (schemes.select(F.col("s.AMFI_Code").cast("string").alias("scheme_code"),
                           F.coalesce(size(headline), size("s.AverageAumForTheMonth.FundOfFundsDomestic")).alias("aaum_cr"),
                           F.struct("ordinal", "i").alias("place"))
                   .filter(F.col("scheme_code").isNotNull() & F.col("aaum_cr").isNotNull()))


def known_aum(groups: DataFrame, master: DataFrame, as_of: str | Column) -> DataFrame:
    """Size rows of schemes the master knows, dated ``as_of`` (a date or column). Of
    several rows for a scheme the last in the feed stays."""
    day = as_of if not isinstance(as_of, str) else F.lit(as_of).cast("date")
    return (aum_rows(groups).join(master.select("scheme_code"), "scheme_code", "left_semi")
            .groupBy("scheme_code").agg(F.max_by("aaum_cr", "place").alias("aaum_cr"))
            .select("scheme_code", day.alias("as_of_date"), "aaum_cr"))


def unknown_aum(groups: DataFrame, master: DataFrame) -> DataFrame:
    """Codes in the feed that the master does not have."""
    return aum_rows(groups).select("scheme_code").distinct().join(master.select("scheme_code"), "scheme_code", "left_anti")


def upserted(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Cost or size rows written over the stored ones, column by column."""
    return upserted_columns(existing, incoming, ["scheme_code", "as_of_date"])
