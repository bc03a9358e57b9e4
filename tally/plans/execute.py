"""Run a report by its name with the reference's filters dict.

A caller that used to call a report's ``execute(filters)`` passes the same
dict here and gets the report's declared columns (labels in the field
metadata) and ``is_total`` as a DataFrame; ``raw=True`` gives all computed
columns.  Every report gets its total row, as the reference asks for one on each.  Keys of the dict: ``from_date``,
``to_date``, ``company``, ``customer``, ``finance_book``, ``item``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame

from tally.functions.dates import DateLike
from tally.plans import reports as rep
from tally.plans.display import display
from tally.plans.params import LedgerParams, OrderParams
from tally.sources.tables import ErpTables

# The report names and whether each asks for a total row.
CUSTOMER_BALANCE_SUMMARY = "Customer Balance Summary for Period"
CUSTOMER_FINANCIAL_STATUS = "Customer Financial Status"
CUSTOMER_RECEIPTS = "Customer Receipts for Period"
ITEM_SALES_FOR_PERIOD = "Item Sales Report for a Specified Period"
ITEM_SALES_FOR_CUSTOMER = "Item Sales Report for Customer"
ADD_TOTAL_ROW = True


def _ledger(filters: Mapping[str, Any], default_company: str | None) -> LedgerParams:
    return LedgerParams.of(
        filters.get("from_date"), filters.get("to_date"), company=filters.get("company"),
        customer=filters.get("customer"), finance_book=filters.get("finance_book"),
        default_company=default_company,
    )


def _orders(filters: Mapping[str, Any], as_of: DateLike) -> OrderParams:
    return OrderParams.of(filters.get("from_date"), filters.get("to_date"), item=filters.get("item"),
                          customer=filters.get("customer"), as_of=as_of)


Runner = Callable[[ErpTables, Mapping[str, Any], str | None, DateLike, bool], DataFrame]

DISPLAYED: dict[str, str] = {
    CUSTOMER_FINANCIAL_STATUS: "customer_financial_status",
    CUSTOMER_BALANCE_SUMMARY: "customer_balance_summary",
    CUSTOMER_RECEIPTS: "customer_receipts",
    ITEM_SALES_FOR_PERIOD: "item_sales_for_period",
    ITEM_SALES_FOR_CUSTOMER: "item_sales_for_customer",
}

REPORTS: dict[str, Runner] = {
    CUSTOMER_FINANCIAL_STATUS: lambda t, f, dc, a, tot: rep.customer_financial_status(t, _ledger(f, dc), tot),
    CUSTOMER_BALANCE_SUMMARY: lambda t, f, dc, a, tot: rep.customer_balance_summary(t, _ledger(f, dc), tot),
    CUSTOMER_RECEIPTS: lambda t, f, dc, a, tot: rep.customer_receipts(t, _ledger(f, dc), tot),
    ITEM_SALES_FOR_PERIOD: lambda t, f, dc, a, tot: rep.item_sales_for_period(t, _orders(f, a), tot),
    ITEM_SALES_FOR_CUSTOMER: lambda t, f, dc, a, tot: rep.item_sales_for_customer(t, _orders(f, a), tot),
}


def execute(t: ErpTables, report: str, filters: Mapping[str, Any] | None = None, *,
            default_company: str | None = None, as_of: DateLike = None,
            with_total: bool = ADD_TOTAL_ROW, raw: bool = False) -> DataFrame:
    """The named report over ``t`` for ``filters`` (a lazy DataFrame)."""
    try:
        run = REPORTS[report]
    except KeyError:
        raise ValueError(f"unknown report {report!r}; known: {sorted(REPORTS)}") from None
    df = run(t, dict(filters or {}), default_company, as_of, with_total)
    return df if raw else display(df, DISPLAYED[report], keep=("is_total",))
