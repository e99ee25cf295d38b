"""Keyed merges of batches into tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def newest_wins(batches: list[DataFrame], keys: list[str]) -> DataFrame:
    """One row per key from ``batches`` given oldest first; a later batch wins as a
    whole row. Rows of one batch that share a key are settled by their values.
    The maximum is taken map-side before the shuffle."""
    values = [c for c in batches[0].columns if c not in keys]
    tagged = [b.select(*keys, F.struct(F.lit(i).alias("batch"), *values).alias("row")) for i, b in enumerate(batches)]
    merged = reduce(DataFrame.unionByName, tagged).groupBy(*keys).agg(F.max("row").alias("row"))
    return merged.select(*keys, *(F.col(f"row.{c}").alias(c) for c in values)).select(*batches[0].columns)


def upserted_columns(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` with the columns that ``incoming`` has written over it by key; its other
    columns stay, and new keys have nulls there. ``incoming`` has one row per key."""
    fed = [c for c in incoming.columns if c not in keys]
    new = incoming.select(*keys, F.lit(True).alias("_fed"), *(F.col(c).alias(f"_new_{c}") for c in fed))
    both = existing.join(new, keys, "full_outer")
    return both.select(*(F.when(F.col("_fed"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in fed else F.col(c) for c in existing.columns))


def replace_groups(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Every key group that ``incoming`` has replaces the existing group whole."""
    kept = existing.join(incoming.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(incoming)


def mark_groups(rows: DataFrame, key: str, values: list[str]) -> DataFrame:
    """(key, n, x, y): groups of the same rows over ``values`` have the same marks, which are their number and two
    independent 64-bit hash sums."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*values)).alias("x"),
                                 F.bit_xor(F.xxhash64(*values, F.lit(1))).alias("y"))


def pending(wanted: DataFrame, status: DataFrame, key: str) -> DataFrame:
    """Keys that carry no status yet: what a resumed load still has to do."""
    return wanted.join(status.filter(F.col("backfill_status").isNotNull()).select(key), key, "left_anti")
