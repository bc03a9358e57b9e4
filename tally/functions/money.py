"""Money columns: exact decimal inside, double at the edge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

# Ledger amounts are DECIMAL(21,9) in the source tables; sums widen by
# Spark's rule and stay exact, so the order of addition cannot change a total.
MONEY = DecimalType(21, 9)


def money(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.cast(MONEY)


def zero() -> Column:
    return F.lit(0).cast(MONEY)


def to_double(col: str | Column) -> Column:
    """Report edge: sums are handed out as DOUBLE, like the reference's floats."""
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("double")
