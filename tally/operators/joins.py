"""Skew-safe lookup join.

Order lines look up their customer's name and their item's grade: many
lines per key on the left, one row per key on the right (the right side is
aggregated by key first).  If one customer or item holds a third of all
lines, a plain shuffle join sends that third to one task, and AQE cannot
split it, because the aggregate lies between the right side's shuffle and the
join.

The join is therefore made on ``struct(key)``: the aggregate's partitioning
does not serve that key, so both sides get a shuffle of their own directly
below the join, and AQE splits the left partitions it measures as skewed.
Nothing is copied or salted, an unskewed run pays one more shuffle of the
small right side, and Spark's size check sees the right side's true size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str) -> DataFrame:
    """``left`` joined to ``right`` (one row per key) on ``left_key == right_key``;
    a NULL key matches nothing."""
    known = right.where(F.col(right_key).isNotNull())
    return left.join(known, F.struct(F.col(left_key).alias("k")) == F.struct(F.col(right_key).alias("k")), how)
