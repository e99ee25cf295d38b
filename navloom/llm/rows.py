"""Rows known by id and text: ids may be null or repeat."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_rows(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Joins on doc_id (null with null) and text_hash, which both sides have; the left's are kept."""
    right = right.withColumnsRenamed({"doc_id": "_doc_id", "text_hash": "_text_hash"})
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_hash") == F.col("_text_hash"))
    return left.join(right, same, how).drop("_doc_id", "_text_hash")
