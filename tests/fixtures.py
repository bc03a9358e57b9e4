"""Hand-made inputs of FIXTURES.md §3 (ledger and order goldens)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from tally.sources.schemas import SCHEMAS
from tally.sources.tables import ErpTables, from_frames

GRADE = "الدرجة"


def d(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


def gl_row(date, ptype, party, voucher, debit=0, credit=0, *, is_opening="No", docstatus=1,
           is_cancelled=0, company="C1", finance_book=None):
    vtype = "Payment Entry" if voucher.startswith("PAY") else "Sales Invoice"
    return (d(date), ptype, party, vtype, voucher, None, None, Decimal(debit), Decimal(credit),
            is_opening, docstatus, is_cancelled, company, finance_book)


GL = [
    gl_row("2024-01-10", "Customer", "A1", "SINV-1", 100),
    gl_row("2024-02-05", "Customer", "A2", "SINV-2", 50, finance_book="FB-1"),
    gl_row("2024-02-10", "Customer", "A1", "PAY-1", 0, 30, finance_book="FB-2"),
    gl_row("2024-02-12", "Customer", "A2", "SRET-1", 0, 20),
    gl_row("2024-02-15", "Customer", "A1", "JV-1", 7, is_opening="Yes"),
    gl_row("2024-03-01", "Customer", "A1", "SINV-9", 999),
    gl_row("2024-02-03", "Customer", "A1", "SINV-3", 11, is_cancelled=1),
    gl_row("2024-02-03", "Customer", "B1", "SINV-4", 40),
    gl_row("2024-02-04", "Customer", "B1", "PAY-2", 0, 40),
    gl_row("2024-02-06", "Customer", "Z9", "SINV-5", 5),
    gl_row("2024-02-07", "Customer", "", "SINV-6", 6),
    gl_row("2024-02-08", "Customer", "D1", "SINV-7", 10),
    gl_row("2024-01-05", "Customer", "E1", "SINV-8", 25),
    gl_row("2024-01-06", "Customer", "E1", "PAY-3", 0, 25),
    gl_row("2024-02-09", "Supplier", "A1", "PINV-1", 0, 3),
    gl_row("2024-02-20", "Customer", "B1", "SRET-0", 0, 8),
    gl_row("2024-02-20", "Customer", "A1", "SINV-10", 13, docstatus=2),
    gl_row("2024-02-21", "Customer", "A1", "SINV-11", 17, company="C2"),
]

MAPPING = [("A1", "Alpha"), ("A2", "Alpha"), ("B1", "Beta"), ("D1", "Delta"), ("D1", "Delta"), ("E1", "Eps")]

SALES_INVOICE = [
    ("SRET-1", 1, 1, d("2024-02-12")),
    ("SRET-0", 1, 1, d("2024-01-15")),
    ("SINV-2", 1, 0, d("2024-02-05")),
]

SALES_ORDER = [
    ("SO-1", "A1", d("2024-02-02"), "To Deliver and Bill", 1, "C1"),
    ("SO-2", "Z9", d("2024-02-03"), "Completed", 1, "C1"),
    ("SO-3", "A2", d("2024-02-03"), "On Hold", 1, "C1"),
    ("SO-4", "A2", d("2024-02-03"), "Draft", 0, "C1"),
    ("SO-5", "D1", d("2024-02-04"), "To Bill", 1, "C1"),
    ("SO-6", "A1", d("2024-02-05"), None, 1, "C1"),
    ("SO-7", "A1", d("2024-03-05"), "Completed", 1, "C1"),
]


def soi(name, parent, item, qty, delivered):
    return (name, parent, item, d("2024-02-15"), float(qty), float(delivered), float(qty) * 10)


SALES_ORDER_ITEM = [
    soi("S1a", "SO-1", "ITEM-X", 10, 4),
    soi("S1b", "SO-1", "ITEM-X", 2, 0),
    soi("S2a", "SO-2", "ITEM-Y", 5, 5),
    soi("S3a", "SO-3", "ITEM-X", 1, 0),
    soi("S4a", "SO-4", "ITEM-X", 1, 0),
    soi("S6a", "SO-6", "ITEM-X", 1, 0),
    soi("S7a", "SO-7", "ITEM-X", 1, 0),
    soi("S5a", "SO-5", "ITEM-X", 3, 0),
]

SALES_INVOICE_ITEM = [("S1a", 3.0, 1), ("S1a", 1.0, 1), ("S1a", 9.0, 2), ("S5a", 3.0, 1)]

ITEM_VARIANT_ATTRIBUTE = [("ITEM-X", GRADE, "A"), ("ITEM-X", "size", "L"), ("ITEM-Y", "size", "M")]

DELIVERY_NOTE = [
    ("DN-1", d("2024-02-10"), 1),
    ("DN-2", d("2024-02-12"), 1),
    ("DN-3", d("2024-02-20"), 0),
    ("DN-4", d("2024-02-05"), 1),
]
DELIVERY_NOTE_ITEM = [("DN-1", "S1a"), ("DN-2", "S1a"), ("DN-3", "S1b"), ("DN-4", "S1b")]

COMPANY = [("C1", "EGP"), ("C2", "USD")]


def golden_tables(spark, **overrides) -> ErpTables:
    rows = {
        "gl_entry": GL,
        "customer_mapping": MAPPING,
        "sales_invoice": SALES_INVOICE,
        "sales_order": SALES_ORDER,
        "sales_order_item": SALES_ORDER_ITEM,
        "sales_invoice_item": SALES_INVOICE_ITEM,
        "item_variant_attribute": ITEM_VARIANT_ATTRIBUTE,
        "delivery_note": DELIVERY_NOTE,
        "delivery_note_item": DELIVERY_NOTE_ITEM,
        "company": COMPANY,
    }
    rows.update(overrides)
    frames = {k: spark.createDataFrame(v, SCHEMAS[k]) for k, v in rows.items()}
    return from_frames(spark, **frames)
