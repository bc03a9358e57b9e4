"""Report parameters and their rules (V1-V5).

Parameters are resolved and checked on the driver *before* any plan is
built; they enter the plan only as Column literals (bound values, never
spliced into SQL text).
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from tally.functions.dates import DateLike, default_from_date, parse_date, today

# The error texts.
DATES_SWAPPED = "From Date must be before To Date"
DATES_REQUIRED = "From and To Dates are required."
ORDER_DATES_SWAPPED = "To Date cannot be before From Date."


class ReportError(ValueError):
    """A parameter combination the report refuses."""


@dataclass(frozen=True)
class LedgerParams:
    """Period, company, optional customer name and finance book.

    A missing date means today (V1); ``company=None`` means no company
    filter unless ``default_company`` is given.
    """

    from_date: dt.date
    to_date: dt.date
    company: str | None = None
    customer: str | None = None
    finance_book: str | None = None
    party_type: str = "Customer"
    codes: tuple[str, ...] | None = None  # the customer's codes, where looked up before (reports.with_codes)

    @classmethod
    def of(cls, from_date: DateLike = None, to_date: DateLike = None, company: str | None = None,
           customer: str | None = None, finance_book: str | None = None,
           party_type: str = "Customer", default_company: str | None = None) -> LedgerParams:
        f = parse_date(from_date) or today()
        t = parse_date(to_date) or today()
        if f > t:
            raise ReportError(DATES_SWAPPED)
        return cls(f, t, company or default_company, customer or None, finance_book or None, party_type)

    @classmethod
    def for_form(cls, clock: DateLike = None, **given) -> LedgerParams:
        """As the report's form opens: missing dates are the month up to
        ``clock`` (today); ``given`` as in :meth:`of`."""
        return cls.of(**_form_dates(clock, given))


@dataclass(frozen=True)
class OrderParams:
    """Optional period (both dates or neither), item or customer.

    ``as_of`` replaces CURRENT_DATE in ``delay_days`` so a run repeats.
    ``is_empty`` is V3: no filter at all gives an empty report.
    """

    from_date: dt.date | None = None
    to_date: dt.date | None = None
    item: str | None = None
    customer: str | None = None
    as_of: dt.date = field(default_factory=today)
    is_empty: bool = False

    @classmethod
    def of(cls, from_date: DateLike = None, to_date: DateLike = None, item: str | None = None,
           customer: str | None = None, as_of: DateLike = None) -> OrderParams:
        f, t = parse_date(from_date), parse_date(to_date)
        if (f is None) != (t is None):
            raise ReportError(DATES_REQUIRED)
        if f is not None and t < f:
            raise ReportError(ORDER_DATES_SWAPPED)
        empty = f is None and not item and not customer
        return cls(f, t, item or None, customer or None, parse_date(as_of) or today(), empty)

    @classmethod
    def for_form(cls, clock: DateLike = None, **given) -> OrderParams:
        """As the report's form opens: missing dates are the month up to
        ``clock`` (today), which is also the ``as_of``; ``given`` as in :meth:`of`."""
        return cls.of(**{"as_of": clock, **_form_dates(clock, given)})


def _form_dates(clock: DateLike, given: dict) -> dict:
    """``given`` with the form's default period (X8) for the dates it lacks."""
    now = parse_date(clock) or today()
    period = {"from_date": default_from_date(now), "to_date": now}
    return given | {k: v for k, v in period.items() if not given.get(k)}
