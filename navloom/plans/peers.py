"""Category statistics and peer rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navloom.functions.rounding import rnd
from navloom.operators.positions import median_of, value_positions

_GROUP = ["category", "period"]


def peer_returns(returns: DataFrame, master: DataFrame) -> DataFrame:
    """Returns of the schemes that count as peers: a category and no quality flag."""
    peers = (master.filter(F.col("category").isNotNull() & F.col("data_quality").isNull())
                   .select("scheme_code", "category"))
    return returns.join(peers, "scheme_code")


def category_stats(returns: DataFrame, master: DataFrame) -> DataFrame:
    """Average, exact median, count and newest date per category and period."""
    at = value_positions(peer_returns(returns, master), _GROUP, "ret", F.max("as_of_date").alias("as_of_date"))
    points = F.sum(F.round(F.col("ret") * 100).cast("bigint") * F.col("n"))
    return at.groupBy(*_GROUP).agg(
        rnd(points / (F.sum("n") * 100.0), 2).alias("avg_return"),
        rnd(median_of("ret"), 2).alias("median_return"),
        F.sum("n").alias("scheme_count"), F.max("as_of_date").alias("as_of_date"))


def rankings(returns: DataFrame, master: DataFrame) -> DataFrame:
    """Rank (1 = best, ties share), peer count and percentile (100 = best). The
    only fund of a category has rank 1 and percentile 0."""
    peers = peer_returns(returns, master)
    at = value_positions(peers, _GROUP, "ret")
    rank = F.col("total") - F.col("below") - F.col("n") + 1
    share = F.when(F.col("total") > 1, F.col("below") / (F.col("total") - 1)).otherwise(F.lit(0.0))
    return peers.join(at, [*_GROUP, "ret"]).select(
        "scheme_code", "period", "category", rank.alias("rank_in_category"), F.col("total").alias("category_size"),
        rnd(share * 100, 0).alias("percentile"), "as_of_date")


def top_share_label(percentile: Column) -> Column:
    """The N of 'top N%'."""
    return F.greatest(F.lit(1), (100 - F.round(percentile)).cast("int"))


def percentile_band(percentile: Column) -> Column:
    return F.when(percentile >= 67, "top").when(percentile >= 33, "middle").when(percentile.isNotNull(), "bottom")
