"""The reports (R1-R6) as lazy DataFrame plans.

Each function takes an :class:`ErpTables` and resolved parameters and returns
a DataFrame; none calls an action (with balance snapshots, the choice of the
period end compares file lists first).  Nothing but the plan reaches the driver:
the return-invoice list, the report's order names and the company currency
all stay inside the plan (join, semi join, scalar subquery).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.functions import ymd
from tally.operators import filters as flt
from tally.operators import ledger as led
from tally.operators import orders as ords
from tally.operators.keyset import worth_cutting
from tally.operators.totals import column_totals, with_total_beside, with_total_row
from tally.plans.display import display
from tally.plans.params import LedgerParams, OrderParams
from tally.sources.snapshots import BalanceSnapshots
from tally.sources.tables import ErpTables

# ----------------------------------------------------------------- ledger


def of_customer(df: DataFrame, t: ErpTables, p: LedgerParams) -> DataFrame:
    """F7 on rows with a ``party``: those of the customer name's codes."""
    if p.customer is None:
        return df
    if p.codes is not None:  # a filter the scan can use to skip row groups
        return df.where(F.col("party").isin(*p.codes)) if p.codes else df.where(F.lit(False))
    if p.party_type != "Customer":
        return df.where(F.col("party") == F.lit(p.customer))
    codes = flt.for_customer_name(t.customer_mapping, p.customer).select(F.col("customer_code").alias("_code"))
    return df.join(codes, F.col("party") == F.col("_code"), "left_semi")


MOST_CODES = 1000


def with_codes(t: ErpTables, p: LedgerParams) -> LedgerParams:
    """``p`` with the codes of its customer name, found by a small job, so that
    they reach the ledger's scan as a filter.  A name with more than
    ``MOST_CODES`` codes stays a semi join."""
    if p.customer is None or p.party_type != "Customer":
        return p
    codes = flt.for_customer_name(t.customer_mapping, p.customer).select("customer_code").distinct()
    rows = codes.limit(MOST_CODES + 1).collect()
    return p if len(rows) > MOST_CODES else replace(p, codes=tuple(sorted(r.customer_code for r in rows)))


def ledger_entries(t: ErpTables, p: LedgerParams, period_only: bool,
                   use_finance_book: bool = False, after: dt.date | None = None) -> DataFrame:
    """S1 + F1-F8: the entries a ledger report folds; with ``after`` only those
    dated later (a snapshot has the rest).

    With a customer filter the entries are first cut to that name's codes
    (a semi join), so the aggregation only sees the customer's rows.
    """
    gl = flt.for_party_type(flt.posted(t.gl_entry), p.party_type)
    if period_only:
        gl = flt.in_period(gl, "posting_date", p.from_date, p.to_date)
    else:
        gl = flt.up_to(gl, "posting_date", p.to_date)
    if after is not None:
        gl = gl.where(F.col("posting_date") > F.lit(after))
    gl = flt.for_company(gl, p.company)
    if use_finance_book:
        gl = flt.for_finance_book(gl, p.finance_book)
    return of_customer(gl, t, p).select("posting_date", "party", "voucher_no", "debit", "credit", "is_opening")


def balances_before(t: ErpTables, p: LedgerParams, snapshots: BalanceSnapshots, end: dt.date) -> DataFrame:
    """The snapshot rows a ledger report starts from (F3, F6, F7; F1, F2 and F4
    hold for every entry in a snapshot)."""
    rows = snapshots.balances(end).where(F.col("party_type") == F.lit(p.party_type))
    return of_customer(flt.for_company(rows, p.company), t, p)


def company_currency_col(t: ErpTables, company: str | None) -> F.Column:
    """S10 + P7: the company's default currency as a scalar subquery
    (one value, computed once, inlined into the plan; no join, no collect)."""
    if company is None:
        return F.lit(None).cast("string")
    return (
        t.company.where(F.col("name") == F.lit(company))
        .select(F.max("default_currency"))
        .scalar()
    )


def ledger_report(t: ErpTables, p: LedgerParams, *, period_only: bool = False,
                  use_finance_book: bool = False, with_total: bool = False,
                  adjustments: DataFrame | None = None,
                  adjustment_accounts: Sequence[str] | None = (),
                  snapshots: BalanceSnapshots | None = None) -> DataFrame:
    """R1 (and R2 / R3 by their projections): one row per customer name,
    ordered by first appearance (O4), zero rows suppressed (F10).

    Columns: customer_name, first_posting_date (DATE), the five money
    buckets (DOUBLE), currency, ``adj_*`` when adjustments are given,
    ``is_total`` when ``with_total``.

    With ``snapshots`` the ledger is the one they stand on, as its files are
    now; the history up to the latest sound period end before the period comes
    from the snapshot (all of it is read where there is no sound one).
    """
    end = snapshots.usable(p.from_date) if snapshots is not None and not period_only else None
    if snapshots is not None:
        t = t.replace(gl_entry=lambda: snapshots.entries(end, p.to_date))
    customer_side = p.party_type == "Customer"
    mapping = flt.for_customer_name(t.customer_mapping, p.customer) if customer_side else None
    before = None if end is None else balances_before(t, p, snapshots, end)
    entries = ledger_entries(t, p, period_only, use_finance_book, end)
    returns = flt.return_invoices(t.sales_invoice, p.from_date)
    summary = led.ledger_summary(entries, returns, mapping, p.from_date, p.party_type, before)
    return ledger_rows(summary, t, p, with_total=with_total, adjustments=adjustments,
                       adjustment_accounts=adjustment_accounts)


def ledger_rows(summary: DataFrame, t: ErpTables, p: LedgerParams, *, with_total: bool = False,
                adjustments: DataFrame | None = None, adjustment_accounts: Sequence[str] | None = ()) -> DataFrame:
    """The rows of a ledger report from its sums by customer name."""
    summary = flt.nonzero_ledger_row(summary)
    extra: list[str] = []
    if adjustments is not None:
        summary = (led.apply_found_adjustments(summary, adjustments) if adjustment_accounts is None
                   else led.apply_adjustments(summary, adjustments, adjustment_accounts))
        extra = [c for c in summary.columns if c.startswith("adj_")]
    if with_total:
        summary = with_total_row(summary, "customer_name", [*led.MONEY_COLS, *extra])
    summary = summary.withColumn("currency", company_currency_col(t, p.company))
    order = [F.col("first_posting_date").asc(), F.col("customer_name").asc_nulls_first()]
    if with_total:
        order.insert(0, F.col("is_total").asc())
    summary = summary.orderBy(*order)
    summary = led.money_to_double(summary, list(led.MONEY_COLS) + extra)
    cols = ["customer_name", "first_posting_date", *led.MONEY_COLS, "currency", *extra]
    if with_total:
        cols.append("is_total")
    return summary.select(*cols)


def customer_financial_status(t: ErpTables, p: LedgerParams, with_total: bool = False,
                              snapshots: BalanceSnapshots | None = None) -> DataFrame:
    """Name, opening, invoiced, returned, paid, closing (+ currency)."""
    df = ledger_report(t, p, with_total=with_total, snapshots=snapshots)
    return df.select("customer_name", *led.MONEY_COLS, "currency",
                     *(["is_total"] if with_total else []))


def customer_balance_summary(t: ErpTables, p: LedgerParams, with_total: bool = False,
                             snapshots: BalanceSnapshots | None = None) -> DataFrame:
    """R2: R1 with the (never filled) ``sales`` column after opening."""
    df = customer_financial_status(t, p, with_total, snapshots)
    return display(df, "customer_balance_summary", keep=("currency", "is_total"))


def customer_receipts(t: ErpTables, p: LedgerParams, with_total: bool = False) -> DataFrame:
    """Entries in the period only; first posting date as text; the
    finance book filter applies."""
    df = ledger_report(t, p, period_only=True, use_finance_book=True, with_total=with_total)
    return df.select(
        "customer_name",
        ymd("first_posting_date").alias("posting_date"),
        "paid_amount", "opening_balance", "invoiced_amount", "return_amount", "closing_balance",
        "currency", *(["is_total"] if with_total else []),
    )


def customer_status_with_adjustments(t: ErpTables, p: LedgerParams, accounts: Sequence[str] | None = None,
                                     with_total: bool = False) -> DataFrame:
    """R1 + A8 with the table's adjustments: a column for each of ``accounts``,
    or for every account that occurs (found by a small job first)."""
    adj = t.party_adjustment
    if adj is None:
        raise ValueError("no party_adjustment table")
    df = ledger_report(t, p, adjustments=adj, adjustment_accounts=accounts, with_total=with_total)
    return df.drop("first_posting_date")


# ----------------------------------------------------------------- orders


def _named_orders(t: ErpTables, p: OrderParams, customer: str | None) -> DataFrame:
    """Open orders of the period with their customer name (J4 on orders:
    the name depends only on the order, and orders are fewer than lines).
    With a customer filter the lookup is inner (F7)."""
    mapping = flt.for_customer_name(t.customer_mapping, customer)
    return ords.with_mapping(_open_orders(t, p), mapping, inner=customer is not None)


def item_sales(t: ErpTables, p: OrderParams, with_grade: bool, with_total: bool = False) -> DataFrame:
    """R4 (``with_grade``) / R5: one row per open order line, ordered by
    order date, item, line name (O2).

    As in the reference, R4 filters by item only and R5 by customer only;
    the other parameter does not filter (it only makes the filters
    non-empty, V3).  On tables stored beside their order (``sources.buckets``)
    the customer lookup comes after J3 and J5, which then move no row;
    elsewhere a large table of invoice items is first cut to the listed lines."""
    customer = None if with_grade else p.customer
    item = p.item if with_grade else None
    beside = ords.ORDER_OF_LINE in t.sales_invoice_item.columns and customer is None
    orders = _open_orders(t, p) if beside else _named_orders(t, p, customer)
    lines = flt.for_item(ords.order_lines(orders, t.sales_order_item), item)
    if p.is_empty:  # V3: no filter at all -> empty report, schema kept
        lines = lines.where(F.lit(False))
    cut = not beside and worth_cutting(t.sales_invoice_item)
    detail = ords.with_billed(lines, t.sales_invoice_item, _listed_names(t, p, with_grade) if cut else None)
    if beside:
        detail = ords.with_mapping(detail, t.customer_mapping)
    if with_grade:
        grades = t.item_variant_attribute
        detail = ords.with_grade(detail, grades if item is None else grades.where(F.col("parent") == F.lit(item)))
    detail = ords.line_record(ords.delivery_status(detail, p.as_of), with_grade)
    order = [F.col("date").asc(), F.col("item_code").asc(), F.col("soi_name").asc()]
    if not with_total:
        return detail.orderBy(*order)
    total = column_totals(_report_lines(t, p, with_grade), {"qty": ords.QTY})
    return with_total_beside(detail, total).orderBy(F.col("is_total").asc(), *order)


def _open_orders(t: ErpTables, p: OrderParams) -> DataFrame:
    """The open orders of the period."""
    return ords.orders_view(
        flt.in_period(flt.open_orders(t.sales_order), "transaction_date", p.from_date, p.to_date))


def _listed_orders(t: ErpTables, p: OrderParams, with_grade: bool) -> DataFrame:
    """The orders an item-sales report can list, by the filters on orders
    (R5's customer filter is a semi join here)."""
    orders = _open_orders(t, p)
    if with_grade or p.customer is None:
        return orders
    codes = flt.for_customer_name(t.customer_mapping, p.customer).select(F.col("customer_code").alias("_c"))
    return orders.join(codes, F.col("customer") == F.col("_c"), "left_semi")


def _report_lines(t: ErpTables, p: OrderParams, with_grade: bool) -> DataFrame:
    """The lines an item-sales report lists, from the filters that decide
    them only: its name, billed and grade lookups are left joins and never
    change which lines appear."""
    lines = flt.for_item(ords.order_lines(_listed_orders(t, p, with_grade), t.sales_order_item),
                         p.item if with_grade else None)
    return lines.where(F.lit(False)) if p.is_empty else lines


def _listed_names(t: ErpTables, p: OrderParams, with_grade: bool) -> DataFrame | None:
    """Names (``soi_name``) among which all listed lines are, by the cheapest
    plan: an item's lines need no order, others the narrow columns of J3.
    None where the report has no filter."""
    if with_grade and p.item is not None:
        return flt.for_item(t.sales_order_item, p.item).select(F.col("name").alias("soi_name"))
    if p.from_date is None and (with_grade or p.customer is None):
        return None
    return _report_lines(t, p, with_grade).select("soi_name")


def item_sales_orders(t: ErpTables, p: OrderParams, with_grade: bool = True) -> DataFrame:
    """The distinct orders an item-sales report lists (R6's input)."""
    return _report_lines(t, p, with_grade).select("sales_order").distinct()


def item_sales_for_period(t: ErpTables, p: OrderParams, with_total: bool = False) -> DataFrame:
    """R4."""
    return item_sales(t, p, with_grade=True, with_total=with_total)


def item_sales_for_customer(t: ErpTables, p: OrderParams, with_total: bool = False) -> DataFrame:
    """R5."""
    return item_sales(t, p, with_grade=False, with_total=with_total)


def so_elapsed_time(t: ErpTables, order_names: DataFrame | None = None) -> DataFrame:
    """Seconds from order date to last submitted delivery per
    (order, item), for the orders in ``order_names`` (a frame with a
    ``sales_order`` column, e.g. a report's rows; semi-joined, never
    collected) or for all orders."""
    so = t.sales_order
    if order_names is not None:
        # distinct: a report has a row per line, so a big order repeats
        names = order_names.select(F.col("sales_order").alias("_so")).distinct()
        so = so.join(names, F.col("name") == F.col("_so"), "left_semi")
    lines = ords.order_lines(ords.orders_view(so), t.sales_order_item)
    return ords.elapsed_by_order_item(lines, ords.last_delivery(t.delivery_note, t.delivery_note_item))


def so_elapsed_time_for_report(t: ErpTables, p: OrderParams, with_grade: bool = True) -> DataFrame:
    """R6 for the orders an item-sales report lists.

    R6 joins orders to their lines itself, so an order the report's filters
    on orders let through has all it needs; only an item filter has to look
    at the lines for the orders that have the item."""
    if p.is_empty or (with_grade and p.item is not None):
        return so_elapsed_time(t, item_sales_orders(t, p, with_grade))
    lines = ords.order_lines(_listed_orders(t, p, with_grade), t.sales_order_item)
    return ords.elapsed_by_order_item(lines, ords.last_delivery(t.delivery_note, t.delivery_note_item))
