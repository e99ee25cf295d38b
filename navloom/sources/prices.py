"""The price table: one row per scheme and day, stored by month in versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navloom import schemas
from navloom.session import scratch_dir, scratch_table, settle
from navloom.sources import versions

KEY = ["scheme_code", "date"]


def history_rows(payloads: DataFrame) -> DataFrame:
    """Rows of landed history documents (scheme_code, data[{date, nav}]): day-first
    dates, positive prices; anything else is dropped."""
    rows = payloads.select("scheme_code", F.explode("data").alias("d"))
    date = F.to_date(F.try_to_timestamp(F.col("d.date"), F.lit("dd-MM-yyyy")))
    nav = F.col("d.nav").try_cast("double")
    return (rows.select("scheme_code", date.alias("date"), nav.alias("nav"))
                .filter(F.col("date").isNotNull() & (F.col("nav") > 0) & ~F.isnan("nav") & (F.col("nav") < float("inf"))))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Landed history files, one JSON document per line."""
    return history_rows(spark.read.schema(schemas.NAV_JSON).json(path))


def daily_rows(parsed: DataFrame) -> DataFrame:
    """Price rows of a normalised daily file."""
    return (parsed.filter(F.col("nav").isNotNull() & F.col("nav_date").isNotNull())
                  .select("scheme_code", F.col("nav_date").alias("date"), "nav"))


def _merged(winner: DataFrame, other: DataFrame) -> DataFrame:
    """One row per key; ``other`` fills the keys ``winner`` lacks. Rows of one side
    that share a key give their largest price. Both sides go through one hash
    aggregate that combines before the shuffle."""
    none = F.lit(None).cast("double")
    both = (winner.select(*KEY, F.col("nav").alias("first"), none.alias("second"))
            .unionAll(other.select(*KEY, none.alias("first"), F.col("nav").alias("second"))))
    return both.groupBy(*KEY).agg(F.coalesce(F.max("first"), F.max("second")).alias("nav"))


def one_per_day(nav: DataFrame) -> DataFrame:
    """The table invariant: one row per scheme and day."""
    return nav.groupBy(*KEY).agg(F.max("nav").alias("nav"))


def upserted(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The newer source wins."""
    return _merged(incoming, existing)


def backfilled(existing: DataFrame, history: DataFrame) -> DataFrame:
    """History fills gaps and never overrides a stored price."""
    return _merged(existing, history)


_MONTH = "date_format(date, 'yyyy-MM')"
_ORDER = ["scheme_code", "date"]


def write_prices(nav: DataFrame, path: str) -> versions.Version:
    """Makes ``nav`` the store's next version."""
    nav = nav.select("scheme_code", "date", "nav").filter(F.col("date").isNotNull())
    return versions.replace(one_per_day(nav), path, _MONTH, _ORDER)


def read_prices(spark: SparkSession, path: str, months: list[tuple[int, int]] | None = None, version: versions.Version | None = None) -> DataFrame:
    """Stored prices of the newest version or of one that was pinned; ``months`` reads only their files, and date
    predicates prune row groups, which are sorted by scheme and day."""
    return versions.read(spark, path, schemas.NAV_HISTORY, version, months if months is None else [f"{y:04d}-{m:02d}" for y, m in months])


_BUCKET_ROWS = 4_000_000  # rows of a bucket, about: 64 MB and less


def by_scheme(nav: DataFrame, table: str | None = None, buckets: int | None = None) -> DataFrame:
    """The layout the metric jobs read: a table bucketed by scheme, sorted by day.
    All their windows, aggregates and joins on scheme_code then start without a
    shuffle, so the prices are shuffled once however many jobs read them. The number
    of buckets follows the number of rows, and is at least that of the cores. Without
    a ``table`` name it is a scratch table."""
    spark = nav.sparkSession
    nav = settle(nav.select("scheme_code", "date", "nav"), "nav")
    buckets = buckets or max(spark.sparkContext.defaultParallelism, -(-nav.count() // _BUCKET_ROWS))
    name = table or scratch_table(spark, "nav-by-scheme")
    writer = (nav.repartition(buckets, "scheme_code").write.format("parquet")
                 .mode("overwrite").bucketBy(buckets, "scheme_code").sortBy("scheme_code", "date"))
    (writer if table else writer.option("path", scratch_dir(spark, "nav-by-scheme"))).saveAsTable(name)
    return spark.table(name)


def merge_into_store(spark: SparkSession, path: str, incoming: DataFrame, incoming_wins: bool = True, settled: bool = False) -> versions.Version:
    """Upserts (or only gap-fills) the months that ``incoming`` touches, as a new version: readers see all of the merge or
    nothing, a merge that died changes nothing, and repeating one changes no price."""
    return versions.merge(incoming.select("scheme_code", "date", "nav"), path, schemas.NAV_HISTORY, _MONTH, _ORDER,
                          upserted if incoming_wins else backfilled, settled)
