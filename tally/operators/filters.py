"""Row filters (F1-F17).  Each is ``DataFrame -> DataFrame``; an optional
parameter of ``None`` leaves the frame unchanged.  All are plain predicates
on source columns, so Catalyst pushes them to the scans."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the reference's order filter (F11) and grade lookup.
CLOSED_ORDER_STATUSES = ("Stopped", "Closed", "On Hold")
GRADE_ATTRIBUTE = "الدرجة"


def posted(gl: DataFrame) -> DataFrame:
    """F1 + F2: draft or submitted, not cancelled."""
    return gl.where((F.col("docstatus") < 2) & (F.col("is_cancelled") == 0))


def for_party_type(gl: DataFrame, party_type: str) -> DataFrame:
    """F3 + F4: one party type, and a non-empty party."""
    return gl.where(
        (F.col("party_type") == F.lit(party_type)) & (F.coalesce(F.col("party"), F.lit("")) != "")
    )


def up_to(df: DataFrame, date_col: str, to_date: dt.date) -> DataFrame:
    """All history up to ``to_date`` (opening needs it)."""
    return df.where(F.col(date_col) <= F.lit(to_date))


def in_period(df: DataFrame, date_col: str, from_date: dt.date | None,
              to_date: dt.date | None) -> DataFrame:
    """Inclusive BETWEEN, only when both ends are given."""
    if from_date is None or to_date is None:
        return df
    return df.where(F.col(date_col).between(F.lit(from_date), F.lit(to_date)))


def for_company(df: DataFrame, company: str | None) -> DataFrame:
    """F6."""
    return df if company is None else df.where(F.col("company") == F.lit(company))


def for_finance_book(gl: DataFrame, finance_book: str | None) -> DataFrame:
    """F8: the book itself or no book at all."""
    if finance_book is None:
        return gl
    return gl.where(F.coalesce(F.col("finance_book"), F.lit("")).isin(finance_book, ""))


def for_customer_name(mapping: DataFrame, customer: str | None) -> DataFrame:
    """F7 applied to the mapping side: the later left join becomes inner."""
    return mapping if customer is None else mapping.where(F.col("customer_name") == F.lit(customer))


def return_invoices(sales_invoice: DataFrame, from_date: dt.date) -> DataFrame:
    """F9 (S3): names of submitted returns dated on or after ``from_date``.

    Only a lower bound, and no company: as the reference does.
    """
    return sales_invoice.where(
        (F.col("docstatus") == 1) & (F.col("is_return") == 1) & (F.col("posting_date") >= F.lit(from_date))
    ).select("name")


def nonzero_ledger_row(df: DataFrame) -> DataFrame:
    """drop rows whose opening, invoiced, paid and returned are all zero.

    closing = opening + invoiced - returned - paid, so testing it adds nothing.
    """
    cols = ("opening_balance", "invoiced_amount", "paid_amount", "return_amount")
    keep = F.lit(False)
    for c in cols:
        keep = keep | (F.col(c) != 0)
    return df.where(keep)


def open_orders(sales_order: DataFrame) -> DataFrame:
    """F11 + F12: submitted, and not stopped / closed / on hold (NULL status drops)."""
    return sales_order.where(
        ~F.col("status").isin(*CLOSED_ORDER_STATUSES) & (F.col("docstatus") == 1)
    )


def for_item(lines: DataFrame, item: str | None) -> DataFrame:
    """F14."""
    return lines if item is None else lines.where(F.col("item_code") == F.lit(item))


def submitted_invoice_items(sales_invoice_item: DataFrame) -> DataFrame:
    """F16: the ON-clause condition of J5, applied before the join."""
    return sales_invoice_item.where(F.col("docstatus") == 1)


def grade_attributes(item_variant_attribute: DataFrame, attribute: str = GRADE_ATTRIBUTE) -> DataFrame:
    """the ON-clause condition of J6, applied before the join."""
    return item_variant_attribute.where(F.col("attribute") == F.lit(attribute))


def submitted_delivery_notes(delivery_note: DataFrame) -> DataFrame:
    """F15 (second half): ``dn.docstatus = 1``."""
    return delivery_note.where(F.col("docstatus") == 1)
