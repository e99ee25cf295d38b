"""Substring search over scheme and house names by a trigram posting table.

A pattern's fixed text of three ASCII characters and more gives trigrams that every match must hold. The schemes that have
them all in one field are candidates, and ``ilike`` decides, so ``%`` and ``_`` stay live. A pattern without such a text
(fewer than three characters between wildcards) has no trigrams and looks at every scheme.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ("name", "amc")
BUCKETS = 32  # of trigrams, by hash: a search reads those of its own
_POSTINGS = "gram STRING, field STRING, scheme_code STRING, bucket INT"
_FIXED = re.compile(r"[\x20-\x24\x26-\x5B\x5D\x5E\x60-\x7E]{3,}")  # ASCII text without %, _ and the escape character


def _trigrams(text: Column) -> Column:
    low = F.lower(text)
    places = F.when(F.length(low) >= 3, F.sequence(F.lit(1), F.length(low) - 2))
    return F.array_distinct(F.transform(places, lambda i: F.substring(low, i, 3)))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def write_index(master: DataFrame, path: str) -> None:
    """Writes the postings (gram, field, scheme_code) of every scheme, by bucket, sorted by gram."""
    each = [master.select("scheme_code", F.lit(field).alias("field"), F.explode(_trigrams(F.col(field))).alias("gram")) for field in FIELDS]
    rows = each[0].unionByName(each[1]).distinct().withColumn("bucket", _bucket(F.col("gram")))
    # rebalance splits a bucket with a trigram of most names over several files
    (rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram", "scheme_code")
         .write.mode("overwrite").partitionBy("bucket").parquet(path))


def pattern_grams(q: str) -> list[str]:
    """The trigrams that every text with ``q`` in it holds."""
    return sorted({run[i:i + 3].lower() for run in _FIXED.findall(q) for i in range(len(run) - 2)})


def candidates(spark: SparkSession, path: str, q: str) -> DataFrame | None:
    """(scheme_code) of the schemes whose name or house has all trigrams of the pattern; None if it has none."""
    grams = pattern_grams(q)
    if not grams:
        return None
    asked = spark.createDataFrame([(g,) for g in grams], "gram STRING").select(_bucket(F.col("gram")).alias("b")).distinct()
    buckets = [r.b for r in asked.collect()]  # at most one per trigram of the pattern
    rows = spark.read.schema(_POSTINGS).parquet(path).filter(F.col("bucket").isin(buckets) & F.col("gram").isin(grams))
    return rows.groupBy("scheme_code", "field").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(grams)).select("scheme_code").distinct()


def narrowed(card: DataFrame, path: str, q: str | None) -> DataFrame:
    """The rows of ``card`` that can match the pattern; all of them without one, or with one that has no trigrams."""
    found = candidates(card.sparkSession, path, q) if q else None
    return card if found is None else card.join(found, "scheme_code", "left_semi")
