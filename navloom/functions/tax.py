"""Tax class of a fund and tax on a redeemed gain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from navloom import constants as K
from navloom.functions.rounding import rnd


def _has_any(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(words))


def tax_class(category: Column, name: Column) -> Column:
    """Non-equity words decide first, unless the fund is an equity index fund;
    everything else is equity."""
    text = F.lower(F.concat_ws(" ", F.coalesce(category, F.lit("")), F.coalesce(name, F.lit(""))))
    equity_index = _has_any(text, ["index", "etf"]) & _has_any(text, K.EQUITY_INDEX_WORDS)
    return F.when(_has_any(text, K.NON_EQUITY_WORDS) & ~equity_index, "non_equity").otherwise("equity")


def gain_type(gain: Column, holding_days: Column, cls: Column) -> Column:
    short = F.coalesce(holding_days < K.LTCG_MIN_DAYS, F.lit(False))
    return (F.when(gain <= 0, "none").when(cls != "equity", "slab")
             .when(short, "STCG").otherwise("LTCG"))


def _raw_tax(gain: Column, kind: Column, marginal_rate: Column) -> Column:
    return (F.when(kind == "none", F.lit(0.0))
             .when(kind == "STCG", gain * K.STCG_RATE)
             .when(kind == "LTCG", F.greatest(F.lit(0.0), gain - K.LTCG_EXEMPTION) * K.LTCG_RATE)
             .otherwise(gain * marginal_rate))


def tax_amount(gain: Column, kind: Column, marginal_rate: Column) -> Column:
    return rnd(_raw_tax(gain, kind, marginal_rate), 2)


def effective_rate_pct(gain: Column, kind: Column, marginal_rate: Column) -> Column:
    return F.when(kind == "none", F.lit(0.0)).otherwise(rnd(_raw_tax(gain, kind, marginal_rate) / gain * 100, 2))
