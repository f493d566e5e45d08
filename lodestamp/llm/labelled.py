"""Labels of documents for the operators that learn from them: all, or a bounded, deterministic sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAINS = 1_000_000


def all_labels(labels: DataFrame, label_col: str, where: Column | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id_col, label) of every labelled id. An id with several labels has the smallest; null ids and labels don't count."""
    named = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("label")).dropna()
    if where is not None:
        named = named.where(where)
    return named.groupBy(id_col).agg(F.min("label").alias("label"))


def sampled_labels(labels: DataFrame, label_col: str, max_rows: int, where: Column | None = None, id_col: str = "doc_id") -> DataFrame:
    """The same of about ``max_rows`` ids at most, chosen by the id's hash; all of them if there are no more."""
    named = all_labels(labels, label_col, where, id_col)
    n = named.count()
    if n <= max_rows:
        return named
    return named.where(F.pmod(F.xxhash64(F.lit("label sample"), id_col), F.lit(GRAINS)) < max_rows * GRAINS // n)
