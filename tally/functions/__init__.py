"""Scalar expressions (built-in Spark functions only)."""

from tally.functions.dates import (
    as_date,
    days_between,
    default_from_date,
    parse_date,
    seconds_between,
    today,
    ymd,
)
from tally.functions.money import MONEY, money, to_double, zero
from tally.functions.names import adjustment_column, scrub

__all__ = [
    "MONEY", "adjustment_column", "as_date", "days_between", "default_from_date",
    "money", "parse_date", "scrub", "seconds_between", "to_double", "today", "ymd", "zero",
]
