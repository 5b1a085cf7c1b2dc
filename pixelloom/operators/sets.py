"""Ordered set operations on file lists and top-k selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_distinct(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("_r", rank).filter(F.col("_r") == 1).drop("_r")


def append_new(existing: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of ``new`` whose key is not yet in ``existing``, each key once, in the order first seen."""
    return ordered_distinct(new.join(existing.select(key), key, "left_anti"), key, order)


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group; ``order`` ends in tie-breaks."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k)
