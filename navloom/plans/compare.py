"""Side-by-side comparison of scheme sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navloom import constants as K
from navloom.plans.explorer import period_rows

_RISK_ROWS = {"Sharpe (3Y)": "sharpe", "Volatility (3Y)": "stdev", "Max drawdown (3Y)": "max_drawdown"}
_LOWER_IS_BETTER = ["Volatility (3Y)"]


def compare_table(sets: DataFrame, master: DataFrame, returns: DataFrame, stats: DataFrame, risk: DataFrame, proxies: DataFrame) -> DataFrame:
    """(set_id, position, scheme_code, name, category, data_quality, period, ...): every scheme of
    every set over all seven periods, its return beside its benchmark's and its category's average,
    and over one and three years its risk, beta and alpha. What is not known is null."""
    about = master.select("scheme_code", "name", "category", "data_quality")
    periods = F.explode(F.array(*map(F.lit, K.PERIOD_DAYS))).alias("period")
    measured = risk.select("scheme_code", "period", "stdev", "sharpe", "beta", "alpha", "max_drawdown")
    rows = sets.select("set_id", "position", "scheme_code", periods).join(about, "scheme_code", "left")
    return (rows.join(period_rows(master, returns, stats, proxies).drop("position"), ["scheme_code", "period"], "left")
            .join(measured, ["scheme_code", "period"], "left"))


def compare_best(sets: DataFrame, returns: DataFrame, risk: DataFrame) -> DataFrame:
    """(set_id, metric, scheme_code, value, is_best) for sets (set_id, position,
    scheme_code) of any size: seven returns, then Sharpe, volatility and drawdown
    over three years. The first best value of a row wins."""
    rets = returns.select("scheme_code", F.concat("period", F.lit(" return")).alias("metric"), F.col("ret").alias("value"))
    three = risk.filter(F.col("period") == "3Y").select("scheme_code", F.explode(F.array(*(
        F.struct(F.lit(label).alias("metric"), F.col(column).alias("value")) for label, column in _RISK_ROWS.items()))).alias("m")
    ).select("scheme_code", "m.*")
    metrics = F.array(*(F.lit(m) for m in [*(f"{p} return" for p in K.PERIOD_DAYS), *_RISK_ROWS]))
    cells = (sets.withColumn("metric", F.explode(metrics))
             .join(rets.unionByName(three), ["scheme_code", "metric"], "left"))
    goodness = F.when(F.col("metric").isin(_LOWER_IS_BETTER), -F.col("value")).otherwise(F.col("value"))
    rank = F.struct(goodness.alias("goodness"), (-F.col("position")).alias("first"))
    best = (cells.filter(F.col("value").isNotNull()).groupBy("set_id", "metric").agg(F.max(rank).alias("best"))
                 .select("set_id", "metric", (-F.col("best.first")).alias("best_position")))
    is_best = F.coalesce(F.col("position") == F.col("best_position"), F.lit(False))
    return cells.join(best, ["set_id", "metric"], "left").select("set_id", "metric", "scheme_code", "value", is_best.alias("is_best"))
