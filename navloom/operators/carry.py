"""Forward-fill over the lines of files of any size.

Lines are addressed by (file, block, pos). Each block, a scan split, is filled
on its own; what the blocks before it carry in comes from a small table with
one row per block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def carry_forward(lines: DataFrame, columns: list[str]) -> DataFrame:
    """Replaces each column by its newest non-null value at or before the line."""
    within = (Window.partitionBy("file", "block").orderBy("pos")
                    .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = (Window.partitionBy("file").orderBy("block")
                    .rowsBetween(Window.unboundedPreceding, -1))
    # only the few lines that set a context are sorted for the ends of the blocks
    context = lines.filter(F.coalesce(*columns).isNotNull()).groupBy("file", "block").agg(
        *(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(c) for c in columns))
    ends = lines.select("file", "block").distinct().join(context, ["file", "block"], "left")
    carried = ends.select("file", "block", *(F.last(c, ignorenulls=True).over(before).alias(f"_in_{c}") for c in columns))
    filled = lines.select(*(c for c in lines.columns if c not in columns),
                          *(F.last(c, ignorenulls=True).over(within).alias(c) for c in columns))
    return (filled.join(carried, ["file", "block"])
                  .withColumns({c: F.coalesce(F.col(c), F.col(f"_in_{c}")) for c in columns})
                  .drop(*(f"_in_{c}" for c in columns)))
