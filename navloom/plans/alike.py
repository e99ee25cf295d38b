"""Every pair of portfolios whose overlap reaches a threshold, over all funds.

A weighted similarity join with prefix filtering. Instruments have one order over all portfolios, the rarest first.
A portfolio's prefix ends where the weight of the instruments after it is below the threshold. Two portfolios that share
nothing in both prefixes share only instruments after one of them, so less than the threshold: only prefixes are joined.
The pairs that they give are bounded again by what is shared so far and the lighter rest, and the ones left are
verified on whole portfolios.

Funds with equal portfolios, such as the plans of one fund, are one class. Pairs are between the classes' first funds;
``portfolio_classes`` says who belongs to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from navloom.functions.rounding import rnd
from navloom.operators.merge import mark_groups
from navloom.plans.overlap import shared_positions
from navloom.session import settle

LEAST_OVERLAP = 5.0  # per cent of the portfolios
_SLACK = 0.005 + 1e-6  # an overlap is judged rounded to two places
_TILE = 2_000  # funds with one instrument in their prefix that meet in a task, on each side


def portfolio_classes(weights: DataFrame) -> DataFrame:
    """(scheme_code, class, funds): funds with the same instruments at the same weights share ``class``, the smallest
    code among them; ``funds`` is their number."""
    marks = settle(mark_groups(weights, "scheme_code", ["isin", "pct"]), "portfolio-marks")
    by = ["n", "x", "y"]
    classes = settle(marks.groupBy(*by).agg(F.min("scheme_code").alias("class"), F.count(F.lit(1)).alias("funds")), "portfolio-classes")
    return marks.join(classes, by).select("scheme_code", "class", "funds")


def _prefixes(weights: DataFrame, least: float) -> DataFrame:
    """(scheme_code, isin, pct, after): the rows of each portfolio's prefix; ``after`` is its weight behind the row."""
    holders = weights.groupBy("isin").agg(F.count(F.lit(1)).alias("holders"))
    order = Window.partitionBy("scheme_code").orderBy(F.desc("holders"), F.desc("isin"))
    # from the commonest instrument back: the running weight is the row's and all behind it; a short position adds nothing
    placed = (weights.withColumn("pct", F.greatest("pct", F.lit(0.0))).join(holders, "isin")
              .withColumn("from_here", F.sum("pct").over(order.rowsBetween(Window.unboundedPreceding, 0))))
    return (placed.filter(F.col("from_here") >= least)
            .select("scheme_code", "isin", "pct", (F.col("from_here") - F.col("pct")).alias("after")))


def _tiled(prefixes: DataFrame, tile: int) -> DataFrame:
    """Prefix rows with ``part`` of ``parts`` of their instrument: a list of holders that is long is dealt into parts by
    the fund's hash, and pairs of parts are compared in tasks of their own."""
    lists = settle(prefixes.groupBy("isin").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("parts")).filter("parts > 1"), "long-lists")
    return (prefixes.join(lists, "isin", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
            .withColumn("part", F.pmod(F.xxhash64("scheme_code"), F.col("parts")).cast("int")))


def candidate_pairs(weights: DataFrame, least: float, tile: int = _TILE) -> DataFrame:
    """(a, b), a before b, of all pairs whose overlap can reach ``least``."""
    rows = settle(_tiled(settle(_prefixes(weights, least), "prefix-rows"), tile), "prefixes")
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    # part i of a list meets part j in the tile (i, j), as its left side if i <= j
    left = rows.select("isin", F.col("part").alias("i"), F.explode(others).alias("j"), *(F.col(c).alias(f"a_{c}") for c in ("scheme_code", "pct", "after"))).filter("i <= j")
    right = rows.select("isin", F.explode(others).alias("i"), F.col("part").alias("j"), *(F.col(c).alias(f"b_{c}") for c in ("scheme_code", "pct", "after"))).filter("i <= j")
    met = left.join(right, ["isin", "i", "j"]).filter((F.col("a_scheme_code") != F.col("b_scheme_code"))
                                                      & ((F.col("i") < F.col("j")) | (F.col("a_scheme_code") < F.col("b_scheme_code"))))
    a, b = F.least("a_scheme_code", "b_scheme_code").alias("a"), F.greatest("a_scheme_code", "b_scheme_code").alias("b")
    # what both prefixes share, and the lighter of what is behind the last of it
    bound = F.sum(F.least("a_pct", "b_pct")) + F.least(F.min("a_after"), F.min("b_after"))
    reach = F.least(F.col("a_pct") + F.col("a_after"), F.col("b_pct") + F.col("b_after"))
    return met.groupBy(a, b).agg(bound.alias("bound"), F.max(reach).alias("reach")).filter((F.col("bound") >= least) & (F.col("reach") >= least)).select("a", "b")


def overlap_above(weights: DataFrame, threshold: float = LEAST_OVERLAP, tile: int = _TILE) -> DataFrame:
    """(a, b, overlap_pct, common_count, a_funds, b_funds): every pair of different portfolios whose overlap, rounded to
    two places, is ``threshold`` or more; ``a`` < ``b`` stand for their classes of ``a_funds`` and ``b_funds`` funds.
    ``weights`` has one row per (scheme_code, isin); ``threshold`` is above 0, as funds that share nothing are never looked
    at."""
    if threshold <= _SLACK:
        raise ValueError("the threshold must be above 0.01")
    classes = settle(portfolio_classes(weights), "classes")
    heads = classes.filter(F.col("scheme_code") == F.col("class")).select("scheme_code", "funds")
    own = settle(weights.join(heads.select("scheme_code"), "scheme_code", "left_semi").select("scheme_code", "isin", "pct"), "class-weights")
    pairs = settle(candidate_pairs(own, threshold - _SLACK, tile), "candidates")
    found = (shared_positions(pairs, own).groupBy("a", "b")
             .agg(rnd(F.sum(F.least("a_pct", "b_pct")), 2).alias("overlap_pct"), F.count(F.lit(1)).alias("common_count"))
             .filter(F.col("overlap_pct") >= threshold))
    for side in ("a", "b"):
        found = found.join(heads.select(F.col("scheme_code").alias(side), F.col("funds").alias(f"{side}_funds")), side)
    return found.select("a", "b", "overlap_pct", "common_count", "a_funds", "b_funds")
