"""Percentages over small count tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_share(counts: DataFrame, count: str, name: str = "pct") -> DataFrame:
    """Add the percentage of the total. ``counts`` holds one row per fixed code,
    so the single-partition window stays tiny whatever the input size.
    """
    whole = Window.partitionBy(F.lit(0))
    return counts.withColumn(name, F.round(F.col(count) / F.sum(count).over(whole) * 100, 2))
