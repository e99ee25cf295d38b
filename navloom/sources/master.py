"""The scheme master."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navloom import constants as K

_REFRESHED = ["name", "amc", "scheme_type", "category", "sub_category", "plan_type", "option_type", "isin", "fund_group_id"]


def one_per_scheme(parsed: DataFrame) -> DataFrame:
    """A file may list a scheme twice; one row per code is kept."""
    row = F.max(F.struct("nav_date", *_REFRESHED)).alias("r")
    return parsed.groupBy("scheme_code").agg(row).select("scheme_code", *(F.col(f"r.{c}").alias(c) for c in _REFRESHED))


def synced(master: DataFrame, parsed: DataFrame, as_of: str) -> DataFrame:
    """Schemes in the file get their attributes refreshed, are stamped as seen and
    active; others keep everything but turn inactive after 30 unseen days. The
    first sighting is never changed."""
    today = F.lit(as_of).cast("date")
    managed = [*_REFRESHED, "first_seen", "last_seen", "is_active"]
    kept = [c for c in master.columns if c not in managed and c != "scheme_code"]
    old = master.select("scheme_code", *kept, *(F.col(c).alias(f"old_{c}") for c in managed))
    both = old.join(one_per_scheme(parsed).withColumn("seen", F.lit(True)), "scheme_code", "full_outer")
    seen = F.coalesce("seen", F.lit(False))
    last_seen = F.when(seen, today).otherwise(F.col("old_last_seen"))
    expired = F.coalesce(last_seen < F.date_sub(today, K.INACTIVE_AFTER_DAYS), F.lit(False))
    return both.select(
        "scheme_code", *(F.when(seen, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in _REFRESHED),
        (F.when(seen, F.lit(True)).otherwise(F.col("old_is_active")) & ~expired).alias("is_active"),
        F.coalesce("old_first_seen", today).alias("first_seen"), last_seen.alias("last_seen"), *kept)


def backfill_marks(requested: DataFrame, history: DataFrame, as_of: str) -> DataFrame:
    """(scheme_code, backfill_status, backfill_date) of the requested schemes after
    a history load: 'done' where prices came, 'no_data' where none did."""
    loaded = history.select("scheme_code").distinct().withColumn("loaded", F.lit(True))
    status = F.when(F.col("loaded"), "done").otherwise("no_data")
    return requested.select("scheme_code").join(loaded, "scheme_code", "left").select(
        "scheme_code", status.alias("backfill_status"), F.lit(as_of).cast("date").alias("backfill_date"))


def marked(master: DataFrame, marks: DataFrame) -> DataFrame:
    """The master with the marks of the last load written over its own."""
    fresh = marks.select("scheme_code", F.col("backfill_status").alias("new_status"), F.col("backfill_date").alias("new_date"))
    rows = master.join(fresh, "scheme_code", "left")
    return rows.withColumn("backfill_status", F.coalesce("new_status", "backfill_status")).withColumn(
        "backfill_date", F.coalesce("new_date", "backfill_date")).drop("new_status", "new_date")
