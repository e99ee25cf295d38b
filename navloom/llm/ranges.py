"""Ranges of ids that hold about equal bytes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FANOUT = 4096


def even_ranges(rows: DataFrame, id_col: str, bytes_col: str, target: int) -> list[int]:
    """Ascending lower bounds of id ranges that hold about `target` bytes each, the first being the least id.
    Ids are counted in at most 4,096 equal steps at a time; steps that hold more than the target are counted
    again, finer, until they fit or are a single id."""
    low, high = rows.agg(F.min(id_col), F.max(id_col)).first()
    if low is None:
        return []
    weights: dict[int, int] = {}
    spans = [(int(low), int(high) + 1)]
    while spans:
        deeper = []
        for a, b in spans:
            step = max(1, -(-(b - a) // _FANOUT))
            cell = F.expr(f"(CAST({id_col} AS DECIMAL(20, 0)) - CAST('{a}' AS DECIMAL(20, 0))) DIV CAST('{step}' AS DECIMAL(20, 0))")
            for r in rows.where((F.col(id_col) >= a) & (F.col(id_col) <= b - 1)).groupBy(cell.cast("long").alias("cell")).agg(F.sum(bytes_col).alias("n")).collect():
                start = a + r.cell * step
                if r.n > 2 * target and step > 1:
                    deeper.append((start, min(b, start + step)))
                else:
                    weights[start] = r.n
        spans = deeper
    bounds, held = [], target
    for start in sorted(weights):
        if held >= target:
            bounds.append(start)
            held = 0
        held += weights[start]
    return bounds


def in_range(ids: Column, bounds: list[int]) -> Column:
    """The place of each id's range; a null id is in the last."""
    edges = np.array(bounds[1:], np.int64)

    @F.pandas_udf("int")
    def place(values: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, values.to_numpy(np.int64), "right").astype(np.int32))

    return place(F.coalesce(ids, F.lit(np.iinfo(np.int64).max)))
