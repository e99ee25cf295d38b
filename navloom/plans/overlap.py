"""Portfolio overlap, combined exposure and concentration of fund sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from navloom.functions.rounding import rnd
from navloom.operators.merge import mark_groups
from navloom.operators.positions import top_k
from navloom.session import settle, settle_by


def _newest_dates(holdings: DataFrame) -> DataFrame:
    """(scheme_code, as_of_date), settled, so that the planner knows how few rows they are and need not shuffle what meets them."""
    return settle(holdings.groupBy("scheme_code").agg(F.max("as_of_date").alias("as_of_date")), "newest-dates")


def latest_holdings(holdings: DataFrame) -> DataFrame:
    """The rows of every scheme's newest disclosure."""
    return holdings.join(_newest_dates(holdings), ["scheme_code", "as_of_date"])


def portfolio_weights(holdings: DataFrame) -> DataFrame:
    """(scheme_code, as_of_date, isin, pct): lines of one ISIN summed, lines
    without ISIN or weight skipped."""
    lines = holdings.filter(F.col("isin").isNotNull() & (F.col("isin") != "") & F.col("pct_of_aum").isNotNull())
    return lines.groupBy("scheme_code", "as_of_date", "isin").agg(F.sum("pct_of_aum").alias("pct"))


def newest_weights(newest: DataFrame) -> DataFrame:
    """Weights of the newest portfolios, settled: every use below reads files whose
    size the planner knows when it chooses between broadcast and shuffle."""
    return settle(portfolio_weights(newest), "weights")


def instrument_names(holdings: DataFrame) -> DataFrame:
    """(isin, name): one of an instrument's spellings, always the same one. Joined
    to finished rows only, so that text stays out of the large aggregates."""
    return holdings.groupBy("isin").agg(F.min("instrument_name").alias("name"))


def covered_weight(weights: DataFrame) -> DataFrame:
    """Disclosed weight that carries an ISIN; never rescaled to 100."""
    return weights.groupBy("scheme_code", "as_of_date").agg(
        F.count(F.lit(1)).alias("holdings_count"), rnd(F.sum("pct"), 2).alias("covered_pct"))


def set_sizes(sets: DataFrame) -> DataFrame:
    return sets.select("set_id", "scheme_code").distinct().groupBy("set_id").agg(F.count(F.lit(1)).alias("funds"))


def rejected_sets(sets: DataFrame, least: int = 2) -> DataFrame:
    """Sets without two funds to compare, with the reason."""
    return set_sizes(sets).filter(F.col("funds") < least).withColumn("reason", F.lit(f"needs at least {least} schemes"))


def anchored_pairs(sets: DataFrame, position: str | None = None) -> DataFrame:
    """(set_id, a, b): every fund of a set against the set's anchor ``a``, the fund that
    is first by ``position`` (by code without one). One row per further member, so a set
    of any size is answered; ``select("a", "b").distinct()`` gives the pairs to compute."""
    first = F.min_by("scheme_code", F.struct(position, "scheme_code")) if position else F.min("scheme_code")
    # a set has a row per fund at most, so it fits a window; the pairs lie by (a, b) from here on
    anchored = (sets.filter(F.col("set_id").isNotNull()).withColumn("a", first.over(Window.partitionBy("set_id")))
                .select("set_id", "a", F.col("scheme_code").alias("b")).filter(F.col("a") != F.col("b")).distinct())
    return settle_by(anchored, "anchored", "a", "b")


_MEETINGS = 4_000_000  # rows of one instrument that a task makes of its holders, at most


def shared_positions(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """(a, b, isin, a_pct, b_pct) of the instruments a requested pair shares; ``weights`` has one row per (scheme_code, isin).

    Each instrument goes the way that makes fewer rows. One with few holders has them meet each other, and the meetings that
    no pair asks for are dropped; so the many instruments that two funds don't share cost nothing, however many pairs
    there are. One with many holders is looked up for the requested pairs of its holders instead."""
    pairs = settle_by(pairs.select("a", "b").distinct(), "asked-pairs", "a", "b")
    span = F.min("b").alias("first_b"), F.max("b").alias("last_b")
    degrees = settle(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("asked"), *span), "asked-of")
    sides = settle(pairs.select("b").distinct(), "asked-others")
    wa = weights.select(F.col("scheme_code").alias("a"), "isin", F.col("pct").alias("a_pct")).join(degrees, "a")
    wb = weights.select(F.col("scheme_code").alias("b"), "isin", F.col("pct").alias("b_pct")).join(sides, "b", "left_semi")
    holders = (wa.groupBy("isin").agg(F.count(F.lit(1)).alias("a_holders"), F.sum("asked").alias("lookups"))
               .join(wb.groupBy("isin").agg(F.count(F.lit(1)).alias("b_holders")), "isin"))
    meetings = F.col("a_holders") * F.col("b_holders")
    few = settle(holders.select("isin", ((meetings <= F.col("lookups")) & (meetings <= _MEETINGS)).alias("few")), "instrument-holders")
    rare, common = few.filter("few").select("isin"), few.filter("NOT few").select("isin")
    columns = ["a", "b", "isin", "a_pct", "b_pct"]
    # outside of the funds that its side a is asked for, a meeting is dropped before it moves
    met = (wa.drop("asked").join(rare, "isin").join(wb, "isin").filter(F.col("b").between(F.col("first_b"), F.col("last_b")))
           .select(*columns).join(pairs, ["a", "b"], "left_semi"))
    # settled, so that the planner knows when they are few and the pairs need not move to meet them
    own = settle(wa.select("a", "isin", "a_pct").join(common, "isin", "left_semi"), "looked-up")
    if own.isEmpty():
        return met.select(*columns)
    looked_up = pairs.join(own, "a").join(wb.join(common, "isin", "left_semi"), ["b", "isin"])
    return met.select(*columns).unionAll(looked_up.select(*columns))


def overlap_pairs(pairs: DataFrame, holdings: DataFrame) -> DataFrame:
    """(a, b, ..., overlap_pct, common_count, as_of_mismatch): the rows of ``pairs`` with what their funds share. Null where
    a side has disclosed nothing, 0 where the portfolios are disjoint. ``pairs`` may be any list of pairs, of any length,
    and is read twice; its other columns stay."""
    weights, others = newest_weights(latest_holdings(holdings)), [c for c in pairs.columns if c not in ("a", "b")]
    duplicated = shared_positions(pairs, weights).groupBy("a", "b").agg(
        F.sum(F.least("a_pct", "b_pct")).alias("pct"), F.count(F.lit(1)).alias("n"))
    disclosed = settle(weights.groupBy("scheme_code").agg(F.max("as_of_date").alias("as_of")), "disclosed")
    side_a = disclosed.select(F.col("scheme_code").alias("a"), F.col("as_of").alias("a_as_of"))
    side_b = disclosed.select(F.col("scheme_code").alias("b"), F.col("as_of").alias("b_as_of"))
    known = F.col("a_as_of").isNotNull() & F.col("b_as_of").isNotNull()
    # both lists lie by (a, b), so they meet first
    return (pairs.join(duplicated, ["a", "b"], "left").join(side_a, "a", "left").join(side_b, "b", "left")
            .select("a", "b", *others,
                    F.when(known, rnd(F.coalesce("pct", F.lit(0.0)), 2)).alias("overlap_pct"),
                    F.when(known, F.coalesce("n", F.lit(0))).alias("common_count"),
                    F.coalesce(F.col("a_as_of") != F.col("b_as_of"), F.lit(False)).alias("as_of_mismatch")))


def top_common(pairs: DataFrame, holdings: DataFrame, k: int = 10) -> DataFrame:
    """The k largest shared positions of every pair."""
    newest = latest_holdings(holdings)
    shared = shared_positions(pairs, newest_weights(newest)).withColumn("smaller", F.least("a_pct", "b_pct"))
    ranked = top_k(shared, ["a", "b"], [F.desc("smaller"), F.asc("isin")], k)
    return ranked.join(instrument_names(newest), "isin", "left").select(
        "a", "b", "rank", "isin", "name", rnd(F.col("smaller"), 2).alias("min_pct"),
                         rnd(F.col("a_pct"), 2).alias("a_pct"), rnd(F.col("b_pct"), 2).alias("b_pct"))


def alike_sets(members: DataFrame) -> DataFrame:
    """(set_id, like, funds): sets of the same funds share ``like``, the smallest id among
    them. Lists are compared by their length and two independent 64-bit hash sums."""
    marks = settle(mark_groups(members, "set_id", ["scheme_code"]), "set-marks")
    like = settle(marks.groupBy("n", "x", "y").agg(F.min("set_id").alias("like")), "set-likes")
    return marks.join(like, ["n", "x", "y"]).select("set_id", "like", F.col("n").alias("funds"))


_SLACK = 1e-6  # float sums of a few thousand weights stay well inside


_WORDS = 8  # 64-bit words of a mask
_PART_FUNDS = 256  # of a set whose instruments are added up in one task


def _bit(code: str) -> Column:
    """A fund's bit among those of all words, by its hash."""
    return F.pmod(F.xxhash64(code), F.lit(64 * _WORDS)).cast("int")


def _masks(rows: DataFrame, key: str, *extra: Column) -> DataFrame:
    """One row per ``key`` of (key, bit, n, ...): ``every``, a word list of the bits there are, and ``twice``, of those
    that several funds have; ``extra`` aggregates ride along."""
    def word(i: int, condition: Column) -> Column:
        bit = F.expr("shiftleft(1L, bit % 64)")
        return F.bit_or(F.when((F.floor(F.col("bit") / 64) == i) & condition, bit).otherwise(F.lit(0).cast("long")))

    words = [word(i, c).alias(f"{name}_{i}") for name, c in (("every", F.lit(True)), ("twice", F.col("n") > 1)) for i in range(_WORDS)]
    return rows.groupBy(key).agg(*words, *extra)


def _word_names(name: str) -> list[str]:
    return [name, *(f"{name}_{i}" for i in range(1, _WORDS))]


def _others(name: str, code: str = "scheme_code") -> list[Column]:
    """The bits of a group's other funds, word by word: all but the own one, unless another fund has it too."""
    def word(i: int) -> Column:
        own = F.when(F.floor(_bit(code) / 64) == i, F.call_function("shiftleft", F.lit(1).cast("long"), _bit(code) % 64)).otherwise(F.lit(0).cast("long"))
        return F.col(f"every_{i}").bitwiseAND(F.bitwise_not(own)).bitwiseOR(F.col(f"twice_{i}").bitwiseAND(own))

    return [word(i).alias(column) for i, column in enumerate(_word_names(name))]


def _bounded(weights: DataFrame) -> DataFrame:
    """Weights with what their instrument can add up to: ``most``, its largest weight anywhere, ``total``, the sum of all,
    and ``holders``, the bits of the other funds that hold it."""
    long = F.greatest("pct", F.lit(0.0))
    by_bit = (weights.groupBy("isin", _bit("scheme_code").alias("bit"))
              .agg(F.count(F.lit(1)).alias("n"), F.max(long).alias("most"), F.sum(long).alias("total"), F.min("pct").alias("least")))
    traits = _masks(by_bit, "isin", F.max("most").alias("most"), F.sum("total").alias("total"), (F.min("least") < 0).alias("short"))
    return weights.join(traits, "isin").select("scheme_code", "isin", "pct", "most", "total", "short", *_others("holders"))


def _with_floors(members: DataFrame, bounded: DataFrame, k: int) -> DataFrame:
    """Set members with the set's ``floor``, which its k-th instrument reaches for sure, and ``members``, the bits of the
    other members. A member's k heaviest instruments add up to its k-th weight each at least, whatever the others hold of
    them; instruments that some fund is short of don't count for it."""
    kth = top_k(bounded.filter(~F.col("short")).select("scheme_code", "isin", "pct"), ["scheme_code"], [F.desc("pct"), F.asc("isin")], k)
    kth = settle(kth.filter(F.col("rank") == k).select("scheme_code", F.col("pct").alias("kth")), "kth-weights")
    by_bit = members.join(kth, "scheme_code", "left").groupBy("set_id", _bit("scheme_code").alias("bit")).agg(F.count(F.lit(1)).alias("n"), F.max("kth").alias("kth"))
    sets = _masks(by_bit, "set_id", (F.max("kth") - _SLACK).alias("floor"))
    return members.join(sets, "set_id").select(*members.columns, "floor", *_others("members"))


def _ranked(once: DataFrame, bounded: DataFrame, k: int, part: Column | None) -> DataFrame:
    """(set_id, rank, isin, pct, held_by) of the top k of sets given as (set_id, scheme_code, funds). All rows of a set meet
    in one task, which adds them up and ranks them; with a ``part`` they are added up in several."""
    spread = ["set_id"] if part is None else ["set_id", "part"]
    rows = _with_floors(once, bounded, k).join(bounded, "scheme_code")
    reach = F.least("total", F.greatest("pct", F.lit(0.0)) + (F.col("funds") - 1) * F.col("most"))
    shared = reduce(Column.__or__, (F.col(m).bitwiseAND(F.col(h)) != 0 for m, h in zip(_word_names("members"), _word_names("holders"))))
    can = F.col("floor").isNull() | (F.col("pct") >= F.col("floor")) | (shared & (reach >= F.col("floor")))
    rows = rows.filter(can) if part is None else rows.filter(can).withColumn("part", part)
    owned = (rows.select(*spread, "funds", "floor", "isin", "pct").repartition(*spread)
             .groupBy(*spread, "funds", "floor", "isin").agg(F.sum("pct").alias("sum"), F.count(F.lit(1)).alias("held_by"))
             .filter(F.col("floor").isNull() | (F.col("sum") >= F.col("floor"))).withColumn("pct", F.col("sum") / F.col("funds")))
    ranked = top_k(owned.withColumn("order_pct", F.round("pct", 9)), ["set_id"], [F.desc("order_pct"), F.asc("isin")], k)
    return ranked.select("set_id", "rank", "isin", "pct", "held_by")


def combined_exposure(sets: DataFrame, holdings: DataFrame, k: int = 10) -> DataFrame:
    """What an equal split over a set's disclosed funds owns: top k instruments
    with ``pct`` and the number of funds that hold them. Sets of the same funds are
    computed once.

    A member's list is read as far as its weight alone reaches the set's floor. Behind that only the
    instruments are taken that can reach it together with other members: one of them shares a bit with a holder, and the
    instrument's largest weight and total allow it. So all rows of an instrument that can enter the top k are added up, and few
    of the others. The rows that are left are spread by set before they are summed, as hardly two of a task's rows would combine
    before that, and ranked where they lie; those of a large set are spread by instrument too."""
    newest = latest_holdings(holdings)
    weights = newest_weights(newest).select("scheme_code", "isin", "pct")
    # a set's rows lie together from here on, so that aggregates by set combine before they shuffle
    members = sets.select("set_id", "scheme_code").filter("scheme_code IS NOT NULL").repartition("set_id").distinct()
    funds = settle(weights.select("scheme_code").distinct(), "disclosed-funds")
    disclosed = settle(members.join(funds, "scheme_code", "left_semi"), "members").filter("scheme_code IS NOT NULL")
    alike = settle(alike_sets(disclosed), "alike")
    first = alike.filter(F.col("set_id") == F.col("like")).select("set_id", "funds")
    bounded = settle(_bounded(weights), "bounded-weights")
    small, large = first.filter(F.col("funds") <= _PART_FUNDS), first.filter(F.col("funds") > _PART_FUNDS)
    ranked = _ranked(disclosed.join(small, "set_id"), bounded, k, None)
    if not large.isEmpty():
        part = F.pmod(F.xxhash64("isin"), F.ceil(F.col("funds") / _PART_FUNDS)).cast("int")
        ranked = ranked.unionAll(_ranked(disclosed.join(large, "set_id"), bounded, k, part))
    # the rows still lie by set here, so only the short list of sets moves to meet them
    ranked = ranked.withColumnRenamed("set_id", "like").join(alike.select("set_id", "like"), "like")
    return ranked.join(instrument_names(newest), "isin", "left").select("set_id", "rank", "isin", "name", rnd(F.col("pct"), 2).alias("pct"), "held_by")


def concentration(exposure: DataFrame) -> DataFrame:
    """Weight in a set's top 5 and top 10 instruments, from the rounded rows."""
    return exposure.groupBy("set_id").agg(
        rnd(F.sum(F.when(F.col("rank") <= 5, F.col("pct"))), 2).alias("concentration_top5"),
        rnd(F.sum(F.when(F.col("rank") <= 10, F.col("pct"))), 2).alias("concentration_top10"))


def set_freshness(members: DataFrame, holdings: DataFrame) -> DataFrame:
    """Whether a set's funds were disclosed on different dates."""
    newest = _newest_dates(holdings)
    return (members.join(newest, "scheme_code", "left").groupBy("set_id")
            .agg((F.min("as_of_date") != F.max("as_of_date")).alias("differs"))
            .select("set_id", F.coalesce("differs", F.lit(False)).alias("as_of_mismatch")))
