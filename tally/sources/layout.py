"""Writing the ERP tables in the layout the reports read best.

* ``gl_entry`` is partitioned by ``posting_date`` and sorted by party within
  each file.  R3 reads one period, and R1/R2 read everything up to a date,
  so their date predicates become directory pruning (``PartitionFilters``)
  and whole days are never opened.
* ``sales_order`` is partitioned by ``transaction_date`` (R4/R5 periods).
* ``sales_invoice`` is partitioned by ``posting_date``: the return lookup
  reads only invoices dated on or after the period start.
* The other tables are plain parquet folders.

Writing is a normal DataFrame write; reading back is
``tables.from_parquet(spark, root)``, with no change to any report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.sources.tables import TABLES, ErpTables

PARTITION_BY: dict[str, str] = {
    "gl_entry": "posting_date",
    "sales_order": "transaction_date",
    "sales_invoice": "posting_date",
}
SORT_WITHIN: dict[str, tuple[str, ...]] = {
    "gl_entry": ("party", "voucher_no"),
    "sales_order": ("name",),
    "sales_invoice": ("name",),
}


MONTH = "posting_month"


def write_monthly(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write ledger entries in a folder per month of posting (its first day):
    the coarser layout that balance snapshots at month ends stand on."""
    keys = (MONTH, "posting_date", "party")
    dated = df.withColumn(MONTH, F.trunc("posting_date", "MM"))
    dated.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode(mode).option(
        "partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path)


def write_table(df: DataFrame, name: str, path: str, mode: str = "errorifexists") -> None:
    part = PARTITION_BY.get(name)
    if part:
        # Range partitioning on (date, party...) keeps each date in few files,
        # and splits a date holding a third of all rows over several tasks.
        keys = (part, *SORT_WITHIN.get(name, ()))
        df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        df.write.mode(mode).partitionBy(part).parquet(path)
    else:
        df.write.mode(mode).parquet(path)


def write_tables(t: ErpTables, root: str, mode: str = "errorifexists") -> None:
    """Write every table of ``t`` under ``root/<table>``."""
    base = root.rstrip("/")
    for name in TABLES:
        df = getattr(t, name)
        if df is not None:
            write_table(df, name, f"{base}/{name}", mode)
