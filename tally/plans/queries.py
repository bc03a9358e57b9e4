"""Registered queries: every report, total and primitive of SURVEY §2 as a
``(spark, sf_dir) -> DataFrame`` callable over the driver's parquet.

The fixed parameters below are the ones the two-engine check uses; the same
values appear in ``tally.checks.oracle_sql``.  Every query reads whole
tables: no row caps, no key subsets.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.operators import filters as flt
from tally.operators import ledger as led
from tally.operators import orders as ords
from tally.plans import reports as rep
from tally.plans.display import display
from tally.plans.params import LedgerParams, OrderParams
from tally.session import tune
from tally.sources.buckets import from_buckets, write_buckets
from tally.sources.clustering import write_clustered
from tally.sources.layout import write_monthly
from tally.sources.ordered import read_ordered, write_ordered
from tally.sources.snapshots import BalanceSnapshots, month_ends
from tally.sources.tables import ErpTables
from tally.sources.tpch_erp import erp_tables
from tally.sources.work import new_folder

# Fixed parameters of the registered queries.
FROM_DATE = "1997-01-01"
TO_DATE = "1998-12-31"
COMPANY = "ASIA"
CUSTOMER = "Party-3"
FINANCE_BOOK = "FB-1"
ITEM = "ITEM-5"
AS_OF = "2002-01-01"
MIN_BYTES = "tally.keyset.minBytes"
CLOCK = "1998-03-31"  # the day the forms open; a month before is February's last day
ADJUSTMENT_ACCOUNTS = ("Write Off", "Round-Off")

Query = Callable[..., DataFrame]  # (spark, sf_dir, tables=None)


def _tables(spark: SparkSession, sf_dir: str, tables: ErpTables | None) -> ErpTables:
    """The caller's tables, else those derived from ``sf_dir``, listed anew in each call."""
    return tables or erp_tables(tune(spark), sf_dir)


def _ledger(**kw) -> LedgerParams:
    return LedgerParams.of(FROM_DATE, TO_DATE, company=COMPANY, **kw)


def _orders(**kw) -> OrderParams:
    kw.setdefault("from_date", FROM_DATE)
    kw.setdefault("to_date", TO_DATE)
    return OrderParams.of(as_of=AS_OF, **kw)


# ----------------------------------------------------------------- reports

def customer_financial_status(spark, sf_dir, tables=None):
    return rep.customer_financial_status(_tables(spark, sf_dir, tables), _ledger())


def customer_financial_status_for_customer(spark, sf_dir, tables=None):
    return rep.customer_financial_status(_tables(spark, sf_dir, tables), _ledger(customer=CUSTOMER))


def customer_balance_summary(spark, sf_dir, tables=None):
    return rep.customer_balance_summary(_tables(spark, sf_dir, tables), _ledger())


def customer_receipts(spark, sf_dir, tables=None):
    return rep.customer_receipts(_tables(spark, sf_dir, tables), _ledger())


def customer_receipts_for_customer(spark, sf_dir, tables=None):
    return rep.customer_receipts(_tables(spark, sf_dir, tables), _ledger(customer=CUSTOMER))


def customer_receipts_for_finance_book(spark, sf_dir, tables=None):
    return rep.customer_receipts(_tables(spark, sf_dir, tables), _ledger(finance_book=FINANCE_BOOK))


def item_sales_for_period(spark, sf_dir, tables=None):
    return rep.item_sales_for_period(_tables(spark, sf_dir, tables), _orders())


def item_sales_for_item(spark, sf_dir, tables=None):
    return rep.item_sales_for_period(_tables(spark, sf_dir, tables), _orders(item=ITEM))


def item_sales_for_customer(spark, sf_dir, tables=None):
    return rep.item_sales_for_customer(_tables(spark, sf_dir, tables), _orders(customer=CUSTOMER))


def so_elapsed_time(spark, sf_dir, tables=None):
    return rep.so_elapsed_time(_tables(spark, sf_dir, tables))


def so_elapsed_time_for_report(spark, sf_dir, tables=None):
    """R6 for the orders of an item-sales report."""
    return rep.so_elapsed_time_for_report(_tables(spark, sf_dir, tables), _orders())


def so_elapsed_time_for_item(spark, sf_dir, tables=None):
    """R6 for the orders an item's report lists (semi join, not an IN list)."""
    return rep.so_elapsed_time_for_report(_tables(spark, sf_dir, tables), _orders(item=ITEM))


# --------------------------------------------------------- stored layouts

def customer_status_from_snapshot(spark, sf_dir, tables=None):
    """R1 from balance snapshots at month ends and the ledger after the last
    one before the period; the ledger is stored by month first."""
    t = _tables(spark, sf_dir, tables)
    root = new_folder(spark, "ledger")
    write_monthly(t.gl_entry, f"{root}/gl_entry")
    snapshots = BalanceSnapshots(spark, f"{root}/gl_entry", f"{root}/snapshots")
    p = _ledger()
    snapshots.refresh(month_ends(p.from_date - dt.timedelta(days=100), p.to_date))
    return rep.customer_financial_status(t, p, snapshots=snapshots)


def _cutting(query: Query, spark, sf_dir, tables):
    """``query`` with the key bitmaps of large tables, whatever their size."""
    before = spark.conf.get(MIN_BYTES, None)
    spark.conf.set(MIN_BYTES, "0")
    try:
        return query(spark, sf_dir, tables)
    finally:
        spark.conf.unset(MIN_BYTES) if before is None else spark.conf.set(MIN_BYTES, before)


def item_sales_key_cut(spark, sf_dir, tables=None):
    """R4 with the invoice items cut to the period's lines first."""
    return _cutting(item_sales_for_period, spark, sf_dir, tables)


def item_sales_for_item_key_cut(spark, sf_dir, tables=None):
    """R4 of an item with the invoice items cut to its lines first."""
    return _cutting(item_sales_for_item, spark, sf_dir, tables)


def gl_classified_entries_key_cut(spark, sf_dir, tables=None):
    """Entries with their buckets; only possible returns are looked up."""
    return _cutting(gl_classified_entries, spark, sf_dir, tables)


def customer_status_key_cut(spark, sf_dir, tables=None):
    """R1; only vouchers that may be returns are kept apart."""
    return _cutting(customer_financial_status, spark, sf_dir, tables)


def customer_status_clustered(spark, sf_dir, tables=None):
    """R1 of one customer on a ledger in Z-order; its codes reach the scan."""
    t = _tables(spark, sf_dir, tables)
    path = f"{new_folder(spark, 'clustered')}/gl_entry"
    write_clustered(t.gl_entry, "gl_entry", path)
    t = t.replace(gl_entry=spark.read.parquet(path))
    return rep.customer_financial_status(t, rep.with_codes(t, _ledger(customer=CUSTOMER)))


def item_sales_in_order(spark, sf_dir, tables=None):
    """R4 stored in its order and read back with each row's position."""
    path = new_folder(spark, "report")
    order = [F.col("date").asc(), F.col("item_code").asc(), F.col("soi_name").asc()]
    write_ordered(rep.item_sales_for_period(_tables(spark, sf_dir, tables), _orders()), path, order)
    return read_ordered(spark, path)


def item_sales_co_located(spark, sf_dir, tables=None):
    """R4 on tables bucketed by the order."""
    t = _tables(spark, sf_dir, tables)
    root = new_folder(spark, "orders")
    database = root.rpartition("/")[2].replace("-", "_")
    write_buckets(t, database, int(spark.conf.get("spark.sql.shuffle.partitions")), root)
    return rep.item_sales_for_period(from_buckets(spark, database), _orders())


# ------------------------------------------------------------------ totals

def customer_financial_status_with_total(spark, sf_dir, tables=None):
    return rep.customer_financial_status(_tables(spark, sf_dir, tables), _ledger(), with_total=True)


def customer_balance_summary_with_total(spark, sf_dir, tables=None):
    return rep.customer_balance_summary(_tables(spark, sf_dir, tables), _ledger(), with_total=True)


def customer_receipts_with_total(spark, sf_dir, tables=None):
    return rep.customer_receipts(_tables(spark, sf_dir, tables), _ledger(), with_total=True)


def item_sales_for_period_with_total(spark, sf_dir, tables=None):
    return rep.item_sales_for_period(_tables(spark, sf_dir, tables), _orders(), with_total=True)


def item_sales_for_customer_with_total(spark, sf_dir, tables=None):
    return rep.item_sales_for_customer(_tables(spark, sf_dir, tables), _orders(customer=CUSTOMER),
                                       with_total=True)


# -------------------------------------------------------------- primitives

def _party_entries(spark, sf_dir, tables, period_only: bool):
    t = _tables(spark, sf_dir, tables)
    p = _ledger()
    gl = flt.for_party_type(flt.posted(t.gl_entry), p.party_type)
    if period_only:
        gl = flt.in_period(gl, "posting_date", p.from_date, p.to_date)
    else:
        gl = flt.up_to(gl, "posting_date", p.to_date)
    gl = flt.for_company(gl, p.company)
    gl = gl.select("posting_date", "party", "voucher_type", "voucher_no", "debit", "credit", "is_opening")
    named = led.with_customer_name(gl, t.customer_mapping, "party")
    return named.select(
        "posting_date", "party", "customer_name", "voucher_type", "voucher_no",
        F.col("debit").cast("double").alias("debit"),
        F.col("credit").cast("double").alias("credit"),
        "is_opening",
    )


def gl_party_entries(spark, sf_dir, tables=None):
    return _party_entries(spark, sf_dir, tables, period_only=False)


def gl_party_entries_in_period(spark, sf_dir, tables=None):
    return _party_entries(spark, sf_dir, tables, period_only=True)


def gl_classified_entries(spark, sf_dir, tables=None):
    t = _tables(spark, sf_dir, tables)
    p = _ledger()
    entries = rep.ledger_entries(t, p, period_only=False)
    returns = flt.return_invoices(t.sales_invoice, p.from_date)
    classified = led.classify(entries, returns, p.from_date, p.party_type)
    named = led.with_customer_name(classified, t.customer_mapping, "party")
    return named.select(
        "posting_date", "party", "customer_name", "voucher_no",
        F.col("amount").cast("double").alias("amount"), "bucket",
    )


def return_invoices(spark, sf_dir, tables=None):
    t = _tables(spark, sf_dir, tables)
    return flt.return_invoices(t.sales_invoice, _ledger().from_date)


def open_sales_orders(spark, sf_dir, tables=None):
    t = _tables(spark, sf_dir, tables)
    p = _orders()
    so = flt.in_period(flt.open_orders(t.sales_order), "transaction_date", p.from_date, p.to_date)
    return so.select("name", "customer", "transaction_date", "status", "company")


def so_line_billed_qty(spark, sf_dir, tables=None):
    t = _tables(spark, sf_dir, tables)
    lines = t.sales_order_item.select(F.col("name").alias("soi_name"))
    billed = ords.with_billed(lines, t.sales_invoice_item)
    return billed.select(
        "soi_name",
        F.coalesce(F.col("_billed_raw"), F.lit(0)).cast("double").alias("billed_qty"),
    )


def so_line_delivery_status(spark, sf_dir, tables=None):
    t = _tables(spark, sf_dir, tables)
    lines = t.sales_order_item.select(
        F.col("name").alias("soi_name"), "item_code", "delivery_date", "qty", "delivered_qty")
    return ords.delivery_status(lines, _orders().as_of)


def item_grade(spark, sf_dir, tables=None):
    t = _tables(spark, sf_dir, tables)
    return ords.grade_by_item(t.item_variant_attribute).select(
        F.col("_item").alias("item_code"), "grade")


def company_currency(spark, sf_dir, tables=None):
    t = _tables(spark, sf_dir, tables)
    return t.company.select(F.col("name").alias("company"), F.col("default_currency").alias("currency"))


def supplier_ledger_summary(spark, sf_dir, tables=None):
    t = _tables(spark, sf_dir, tables)
    return rep.customer_financial_status(t, _ledger(party_type="Supplier")).withColumnRenamed(
        "customer_name", "party_name")


def customer_status_with_adjustments(spark, sf_dir, tables=None):
    t = _tables(spark, sf_dir, tables)
    return rep.customer_status_with_adjustments(t, _ledger(), ADJUSTMENT_ACCOUNTS)


def customer_status_found_accounts(spark, sf_dir, tables=None):
    """A8 with the accounts that occur."""
    t = _tables(spark, sf_dir, tables)
    return rep.customer_status_with_adjustments(t, _ledger())


def customer_status_default_period(spark, sf_dir, tables=None):
    """R1 as its form opens on CLOCK: the month up to that day."""
    return rep.customer_financial_status(
        _tables(spark, sf_dir, tables), LedgerParams.for_form(CLOCK, company=COMPANY))


def item_sales_default_period(spark, sf_dir, tables=None):
    """R4 as its form opens on CLOCK."""
    return rep.item_sales_for_period(_tables(spark, sf_dir, tables), OrderParams.for_form(CLOCK))


def item_sales_no_filter(spark, sf_dir, tables=None):
    """R4 without any filter: no rows (V3)."""
    return rep.item_sales_for_period(_tables(spark, sf_dir, tables), OrderParams.of(as_of=AS_OF))


def item_sales_display(spark, sf_dir, tables=None):
    t = _tables(spark, sf_dir, tables)
    return display(rep.item_sales_for_period(t, _orders()), "item_sales_for_period")


def item_sales_for_customer_display(spark, sf_dir, tables=None):
    t = _tables(spark, sf_dir, tables)
    return display(rep.item_sales_for_customer(t, _orders(customer=CUSTOMER)), "item_sales_for_customer")


def customer_status_display(spark, sf_dir, tables=None):
    t = _tables(spark, sf_dir, tables)
    return display(rep.customer_financial_status(t, _ledger()), "customer_financial_status")


def customer_receipts_display(spark, sf_dir, tables=None):
    t = _tables(spark, sf_dir, tables)
    return display(rep.customer_receipts(t, _ledger()), "customer_receipts")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        customer_financial_status,
        customer_financial_status_for_customer,
        customer_balance_summary,
        customer_receipts,
        customer_receipts_for_customer,
        customer_receipts_for_finance_book,
        item_sales_for_period,
        item_sales_for_item,
        item_sales_for_customer,
        so_elapsed_time,
        so_elapsed_time_for_report,
        so_elapsed_time_for_item,
        customer_status_from_snapshot,
        item_sales_key_cut,
        item_sales_for_item_key_cut,
        gl_classified_entries_key_cut,
        customer_status_key_cut,
        customer_status_clustered,
        item_sales_in_order,
        item_sales_co_located,
        customer_financial_status_with_total,
        customer_balance_summary_with_total,
        customer_receipts_with_total,
        item_sales_for_period_with_total,
        item_sales_for_customer_with_total,
        gl_party_entries,
        gl_party_entries_in_period,
        gl_classified_entries,
        return_invoices,
        open_sales_orders,
        so_line_billed_qty,
        so_line_delivery_status,
        item_grade,
        company_currency,
        supplier_ledger_summary,
        customer_status_with_adjustments,
        customer_status_found_accounts,
        customer_status_default_period,
        item_sales_default_period,
        item_sales_no_filter,
        item_sales_display,
        item_sales_for_customer_display,
        customer_status_display,
        customer_receipts_display,
    )
}

#: Keys that store tables first, or force the key bitmaps that small tables do not get.
STORING = ("customer_status_from_snapshot", "item_sales_co_located", "customer_status_clustered", "item_sales_in_order")
FORCED = tuple(k for k in QUERIES if k.endswith("_key_cut"))
