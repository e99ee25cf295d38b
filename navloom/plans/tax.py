"""Tax on the gains of backtested plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navloom import constants as K
from navloom.functions import tax


def plan_tax(summary: DataFrame, plans: DataFrame, master: DataFrame) -> DataFrame:
    """(plan_id, tax_class, gain_type, tax, effective_rate_pct) if a plan were
    redeemed at its latest price. ``plans`` gives marginal_rate in percent (null: the
    default slab) and may give a tax_class that overrides the one read from category and name."""
    given = plans.select("plan_id", "marginal_rate",
                         (F.col("tax_class") if "tax_class" in plans.columns else F.lit(None).cast("string")).alias("given"))
    named = master.select("scheme_code", tax.tax_class(F.col("category"), F.col("name")).alias("derived"))
    rows = (summary.join(given, "plan_id").join(named, "scheme_code", "left")
            .withColumn("tax_class", F.when(F.col("given").isin("equity", "non_equity"), F.col("given"))
                                      .otherwise(F.coalesce("derived", F.lit("equity"))))
            .withColumn("gain_type", tax.gain_type(F.col("gain"), F.datediff("end", "start"), F.col("tax_class"))))
    rate = F.coalesce(F.col("marginal_rate") / 100, F.lit(K.DEFAULT_MARGINAL_RATE))
    return rows.select("plan_id", "tax_class", "gain_type",
                       tax.tax_amount(F.col("gain"), F.col("gain_type"), rate).alias("tax"),
                       tax.effective_rate_pct(F.col("gain"), F.col("gain_type"), rate).alias("effective_rate_pct"))
