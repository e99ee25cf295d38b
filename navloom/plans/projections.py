"""Forward projections as column formulas over scenario tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navloom import constants as K
from navloom.functions.rounding import rnd


def _monthly(annual_rate: Column) -> Column:
    return annual_rate / 100 / 12


def _annuity_due(months: Column, r: Column) -> Column:
    """Value of 1 paid at the start of every month; ``months`` at zero rate."""
    return F.when(r == 0, months).otherwise(
        (F.power(1 + r, months) - 1) / F.nullif(r, F.lit(0.0)) * (1 + r))


def project_plans(scenarios: DataFrame) -> DataFrame:
    """Lump sum of ``amount``, monthly instalment of ``amount`` and the instalment
    that reaches ``corpus``, each over ``years`` at ``annual_rate`` percent. The
    instalment for a goal of no months is null."""
    amount, years, rate = F.col("amount"), F.col("years"), F.col("annual_rate")
    n, r = F.rint(years * 12), _monthly(rate)
    lump = amount * F.power(1 + rate / 100, years)
    factor = _annuity_due(n, r)
    goal = F.try_divide(F.col("corpus"), factor)
    return scenarios.select(
        "scenario_id", n.cast("int").alias("months"),
        rnd(lump, 2).alias("lump_value"), rnd(lump - amount, 2).alias("lump_gain"),
        rnd(amount * n, 2).alias("sip_invested"), rnd(amount * factor, 2).alias("sip_value"),
        rnd(amount * factor - amount * n, 2).alias("sip_gain"),
        rnd(goal, 2).alias("goal_monthly"), rnd(goal * n, 2).alias("goal_invested"))


def _balance(month: Column) -> Column:
    """Corpus left after ``month`` withdrawals, unfloored."""
    c, w, r = F.col("corpus"), F.col("monthly_withdrawal"), _monthly(F.col("annual_rate"))
    grown = F.power(1 + r, month)
    return F.when(r == 0, c - w * month).otherwise(c * grown - w * (grown - 1) / F.nullif(r, F.lit(0.0)))


def _depletion_month(horizon: int) -> Column:
    """First month whose balance is not positive, null if there is none; 0 for a corpus
    that is empty from the start. The closed form is settled against its neighbours so that float
    noise at an exact depletion cannot shift it."""
    c, w, r = F.col("corpus"), F.col("monthly_withdrawal"), _monthly(F.col("annual_rate"))
    left = 1 - F.try_divide(c * r, w)
    exact = (F.when(r == 0, F.try_divide(c, w))
              .when(left > 0, -F.ln(left) / F.ln(F.nullif(1 + r, F.lit(1.0)))))
    guess = F.least(F.ceil(exact), F.lit(10 * horizon)).cast("int")
    near = F.filter(F.array(guess - 1, guess, guess + 1), lambda m: (m >= 1) & (_balance(m) <= 0))
    return F.when(c <= 0, 0).when(guess.isNotNull(), F.array_min(near))


def withdrawal_summary(scenarios: DataFrame, max_years: int = K.MAX_WITHDRAWAL_YEARS) -> DataFrame:
    """How many months a corpus lasts; one that runs out only at the horizon of
    ``max_years`` counts as sustained."""
    month = _depletion_month(max_years * 12)
    depleted = F.coalesce(month < max_years * 12, F.lit(False))
    return scenarios.select("scenario_id", F.when(depleted, month).alias("lasts_months"), (~depleted).alias("sustained"))


def withdrawal_schedule(scenarios: DataFrame, max_years: int = K.MAX_WITHDRAWAL_YEARS) -> DataFrame:
    """(scenario_id, year, balance) for every full year up to depletion, floored
    at 0."""
    horizon = F.lit(max_years * 12)
    last = F.least(F.coalesce(_depletion_month(max_years * 12), horizon), horizon)
    years = F.when(last >= 12, F.sequence(F.lit(1), F.floor(last / 12).cast("int")))
    rows = scenarios.withColumn("year", F.explode(years))
    return rows.select("scenario_id", "year", rnd(F.greatest(_balance(F.col("year") * 12), F.lit(0.0)), 2).alias("balance"))
