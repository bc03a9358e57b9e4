"""Order tables stored so that the item reports' large joins move no row.

J3 joins orders to lines by the order's name, J5 lines to invoice items by the
line's name.  Stored by :func:`write_buckets`:

* orders, lines and invoice items are bucketed by the **order**; an invoice item gets its
  line's order once, at writing, in the column ``order_of_line`` (one that has
  none gets a value of its own: it matches no line, and spreads);
* delivery notes and their items are bucketed by the note (J9).

Loaded by :func:`from_buckets`, J3 and J5 join bucket to bucket without an
exchange on either side, and the invoice items are summed without one.  What
is left is the shuffle for the name and grade lookups.

A bucket is one task, which AQE can't split.  The writer therefore refuses a
layout in which one key more than fills ``MOST`` buckets, counted in what it stored:
such tables stay with the plain layout, whose joins AQE splits.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor, as_completed

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.operators.orders import ORDER_OF_LINE
from tally.sources.tables import TABLES, ErpTables, from_catalog

BUCKET_BY: dict[str, str] = {
    "sales_order": "name",
    "sales_order_item": "parent",
    "sales_invoice_item": ORDER_OF_LINE,
    "delivery_note": "name",
    "delivery_note_item": "parent",
}
SORT_BY: dict[str, tuple[str, ...]] = {
    "sales_order": ("name",),
    "sales_order_item": ("parent", "name"),
    "sales_invoice_item": (ORDER_OF_LINE, "so_detail"),
    "delivery_note": ("name",),
    "delivery_note_item": ("parent", "so_detail"),
}
MOST = 2
AT_ONCE = 3  # tables written side by side, so that no core waits for the last tasks of one


def with_order_of_line(invoice_items: DataFrame, lines: DataFrame) -> DataFrame:
    """Invoice items with the order of their line (``name`` is the lines' key)."""
    known = lines.select(F.col("name").alias("_line"), F.col("parent").alias("_order"))
    alone = F.concat(F.lit("\u0000"), F.monotonically_increasing_id().cast("string"))
    return (invoice_items.join(known, F.col("so_detail") == F.col("_line"), "left")
            .withColumn(ORDER_OF_LINE, F.coalesce("_order", alone)).drop("_line", "_order"))


def _check_even(df: DataFrame, name: str, key: str, buckets: int) -> None:
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all"))
    most, rows = sizes.first()
    if rows and most > MOST * max(1, rows // buckets) and most > 100_000:
        raise ValueError(f"{name}: one {key} has {most} of {rows} rows, more than {MOST} of {buckets} buckets hold")


def _write_bucketed(df: DataFrame, database: str, name: str, buckets: int) -> None:
    """Write ``df`` by its bucket key, and check the stored rows: their key
    counts need no exchange and read one column, where a check of ``df`` would
    make all of its rows twice.  A refused table is dropped."""
    key, table = BUCKET_BY[name], f"{database}.{name}"
    (df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(*SORT_BY[name])
     .saveAsTable(table))
    spark = df.sparkSession
    try:
        _check_even(spark.table(table), name, key, buckets)
    except ValueError:
        spark.sql(f"DROP TABLE {table}")
        raise


def write_buckets(t: ErpTables, database: str, buckets: int, location: str | None = None) -> None:
    """Write every table of ``t`` into a new ``database`` (at ``location``), ``AT_ONCE``
    tables at a time; the invoice items look their order up in the stored lines."""
    spark = t.sales_order.sparkSession
    spark.sql(f"CREATE DATABASE `{database}`" + (f" LOCATION '{location}'" if location else ""))
    tables = {name: df for name in TABLES if (df := getattr(t, name)) is not None}

    def write(name: str) -> None:
        if name not in BUCKET_BY:
            tables[name].write.saveAsTable(f"{database}.{name}")
            return
        _write_bucketed(tables[name], database, name, buckets)
        if name == "sales_order_item":
            billed = with_order_of_line(tables["sales_invoice_item"], spark.table(f"{database}.{name}"))
            _write_bucketed(billed, database, "sales_invoice_item", buckets)

    first = ("sales_order_item", *(name for name in tables if name not in ("sales_order_item", "sales_invoice_item")))
    with ThreadPoolExecutor(AT_ONCE) as pool:
        jobs = [pool.submit(inheritable_thread_target(spark)(write), name) for name in first]
        try:
            for job in as_completed(jobs):
                job.result()
        except BaseException:
            pool.shutdown(cancel_futures=True)
            raise


def from_buckets(spark: SparkSession, database: str) -> ErpTables:
    """The tables of a database written by :func:`write_buckets`.  Tables
    bucketed by the order may serve a join on (order, line): the session is
    told to accept that."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return from_catalog(spark, database)
