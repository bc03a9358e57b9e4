"""Date expressions (X2-X8): all built-in, JVM-side Column functions."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DateLike = dt.date | str | None

_ISO = re.compile(r"(\d{4}-\d{2}-\d{2})(?:[ T]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?)?")


def parse_date(value: DateLike) -> dt.date | None:
    """Parameter parsing (X5): ``None`` stays ``None``; text is ISO
    ``YYYY-MM-DD``, with or without a time of day; anything else raises."""
    if value is None or value == "":
        return None
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    found = _ISO.fullmatch(str(value).strip())
    if not found:
        raise ValueError(f"not a date: {value!r}")
    return dt.date.fromisoformat(found[1])


def today() -> dt.date:
    """``nowdate()``: resolved once on the driver, so one run sees one date, in
    UTC like the session."""
    return dt.datetime.now(dt.timezone.utc).date()


def default_from_date(ref: dt.date | None = None) -> dt.date:
    """Form default for the period start (X8): one month before ``ref``."""
    ref = ref or today()
    month = ref.month - 1 or 12
    year = ref.year - (1 if ref.month == 1 else 0)
    for day in (ref.day, 30, 29, 28):
        try:
            return dt.date(year, month, day)
        except ValueError:
            continue
    raise AssertionError("unreachable")


def as_date(col: str | Column) -> Column:
    """Timestamp (with or without zone) or date column to ``DATE``."""
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("date")


def days_between(later: str | Column, earlier: str | Column) -> Column:
    """``DATEDIFF(later, earlier)`` in days, as BIGINT."""
    return F.datediff(later, earlier).cast("bigint")


def seconds_between(later: str | Column, earlier: str | Column) -> Column:
    """``TO_SECONDS(later) - TO_SECONDS(earlier)`` for DATE inputs."""
    return days_between(later, earlier) * F.lit(86400)


def ymd(col: str | Column) -> Column:
    """``strftime('%Y-%m-%d')``."""
    return F.date_format(col, "yyyy-MM-dd")
