"""The nightly rebuild of all metric tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from navloom.plans import peers, quality, returns, risk


def metric_tables(nav: DataFrame, master: DataFrame, proxies: DataFrame, as_of: str,
                  save: Callable[[str, DataFrame], DataFrame] = lambda _, table: table) -> dict[str, DataFrame]:
    """Every metric table. Statistics and rankings use the flags computed here, not
    those already on the master. ``save`` may write the two tables the others
    build on and give them back read from files."""
    rets = save("scheme_returns", returns.scheme_returns(nav))
    flagged = save("scheme_master", quality.with_quality(master, quality.quality_flags(master, nav, as_of)))
    return {
        "scheme_returns": rets,
        "scheme_risk": risk.scheme_risk(nav, master, proxies, as_of),
        "scheme_master": flagged,
        "category_stats": peers.category_stats(rets, flagged),
        "rankings": peers.rankings(rets, flagged),
    }


def table_saver(spark: SparkSession, out: str) -> Callable[[str, DataFrame], DataFrame]:
    """Writes a table whole under ``out`` and reads it back: what builds on it then
    starts from files, and a lost executor costs tasks, not the lineage behind."""
    def save(name: str, table: DataFrame) -> DataFrame:
        path = f"{out.rstrip('/')}/{name}"
        table.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
    return save


def rebuild(spark: SparkSession, nav: DataFrame, master: DataFrame, proxies: DataFrame, as_of: str, out: str) -> dict[str, DataFrame]:
    """Rebuilds all tables under ``out``, which must not hold the inputs. Running
    again gives the same tables."""
    save = table_saver(spark, out)
    tables = metric_tables(nav, master, proxies, as_of, save)
    done = {"scheme_returns", "scheme_master"}
    return {name: table if name in done else save(name, table) for name, table in tables.items()}
