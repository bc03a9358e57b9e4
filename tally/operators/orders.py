"""Sales-order operators.

The reference joins order lines to the mapping, to submitted invoice items
and to grade attributes, then groups by the line (``GROUP BY soi.name``).
Every one of those joins can repeat a line: the billed sum is then
``sum(invoice qty) x (mapping matches) x (grade matches)``, while the line's
own fields stay as they are.

Here each right side is reduced to one row per join key *before* the join
(a partial + final aggregate, so a hot line or item is combined map-side),
carrying its match count.  The customer lookup is made on the orders, not
the lines (it depends only on the order), and the customer and grade
lookups go through ``joins.lookup_join`` so AQE can split a hot customer or
item.  The join then never multiplies rows, no group of
raw invoice rows is ever shuffled as a whole, and the billed quantity is
``coalesce(billed_raw * mapped * graded, 0)``: exactly the reference's sum,
done in DECIMAL so the grouping order cannot change it, with nine decimals
kept to the end (an overflow raises).  Reports with a filter first cut a large
table of invoice items to the selected lines by a bounded bitmap of their
names (``keyset``), before any row of it is shuffled.

``sales_order_item.name`` is the line's primary key, so after these joins
every line is already one row and no final GROUP BY (shuffle) is needed.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from tally.functions import days_between, seconds_between
from tally.operators import filters as flt
from tally.operators.joins import lookup_join
from tally.operators.keyset import within

# The sum of QTY has 31 digits; times a factor of 6 that makes 38 with scale 9,
# so the product is never rounded.
QTY = DecimalType(21, 9)
FACTOR = DecimalType(6, 0)
# Column of invoice items stored beside their order (sources.buckets).
ORDER_OF_LINE = "order_of_line"


def orders_view(sales_order: DataFrame) -> DataFrame:
    """The order columns the reports carry, keyed ``sales_order``."""
    return sales_order.select(
        F.col("name").alias("sales_order"), "customer", "transaction_date", "status", "company",
    )


def order_lines(orders: DataFrame, sales_order_item: DataFrame) -> DataFrame:
    """Orders (``orders_view``, maybe with more columns) joined to
    their lines (inner)."""
    soi = sales_order_item.select(
        F.col("name").alias("soi_name"), F.col("parent").alias("_parent"), "item_code",
        "delivery_date", "qty", "delivered_qty", "base_amount",
    )
    return orders.join(soi, F.col("_parent") == F.col("sales_order")).drop("_parent")


def mapping_by_code(mapping: DataFrame) -> DataFrame:
    """Mapping reduced to one row per code: ``min`` name (§1 item 11) and the
    number of mapping rows (the fan-out factor of J4)."""
    return mapping.groupBy(F.col("customer_code").alias("_code")).agg(
        F.min("customer_name").alias("customer_name"), F.count(F.lit(1)).alias("_mapped"),
    )


def billed_by_line(sales_invoice_item: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """A4 before the join (S6, F16): submitted invoice quantity per line; with
    ``only`` (a frame with ``soi_name``) rows that can't be of its lines are
    cut first.  Co-located rows (``sources.buckets``) keep their order's name."""
    rows = flt.submitted_invoice_items(sales_invoice_item)
    if only is not None:
        rows = within(rows, "so_detail", only, "soi_name")
    keys = [F.col("so_detail").alias("_so_detail")]
    if ORDER_OF_LINE in sales_invoice_item.columns:
        keys.insert(0, F.col(ORDER_OF_LINE).alias("_so_order"))
    return rows.groupBy(*keys).agg(F.sum(F.col("qty").cast(QTY)).alias("_billed_raw"))


def grade_by_item(item_variant_attribute: DataFrame) -> DataFrame:
    """J6's right side (S7, F17): grade per item and its match count."""
    return flt.grade_attributes(item_variant_attribute).groupBy(
        F.col("parent").alias("_item")
    ).agg(F.min("attribute_value").alias("grade"), F.count(F.lit(1)).alias("_graded"))


def with_billed(lines: DataFrame, sales_invoice_item: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Left join of the per-line invoice sums.  ``only`` (the listed
    lines' ``soi_name`` by the cheapest plan) cuts the invoice rows first."""
    billed = billed_by_line(sales_invoice_item, only)
    same = F.col("soi_name") == F.col("_so_detail")
    if "_so_order" in billed.columns:
        same = (F.col("sales_order") == F.col("_so_order")) & same
    return lines.join(billed, same, "left").drop("_so_order", "_so_detail")


def with_mapping(orders: DataFrame, mapping: DataFrame, inner: bool = False) -> DataFrame:
    """Customer name by the order's customer code (inner for F7)."""
    m = mapping_by_code(mapping)
    how = "inner" if inner else "left"
    return lookup_join(orders, m, "customer", "_code", how).drop("_code")


def with_grade(lines: DataFrame, item_variant_attribute: DataFrame) -> DataFrame:
    """Grade of the line's item (left)."""
    g = grade_by_item(item_variant_attribute)
    return lookup_join(lines, g, "item_code", "_item", "left").drop("_item")


def delivery_status(lines: DataFrame, as_of: dt.date) -> DataFrame:
    """P2 + P3: pending quantity and days since the promised delivery."""
    return lines.withColumn("pending_qty", F.col("qty") - F.col("delivered_qty")).withColumn(
        "delay_days", days_between(F.lit(as_of), F.col("delivery_date"))
    )


def billed_qty(with_grade_factor: bool) -> F.Column:
    """A4: the reference's ``IFNULL(SUM(sii.qty), 0)`` over the joined rows."""
    factor = F.coalesce(F.col("_mapped"), F.lit(1))
    if with_grade_factor:
        factor = factor * F.coalesce(F.col("_graded"), F.lit(1))
    return F.coalesce(F.col("_billed_raw") * factor.cast(FACTOR), F.lit(0).cast(QTY)).cast("double")


def line_record(df: DataFrame, with_grade_col: bool) -> DataFrame:
    """The order-line record of R4 (with grade) / R5."""
    cols = [
        F.col("transaction_date").alias("date"),
        "delivery_date",
        "sales_order",
        "status",
        "customer_name",
        "item_code",
        "delay_days",
        "qty",
        "delivered_qty",
        "pending_qty",
        billed_qty(with_grade_col).alias("billed_qty"),
        F.col("base_amount").alias("amount"),
        "company",
        "soi_name",
    ]
    if with_grade_col:
        cols.append("grade")
    return df.select(*cols)


def last_delivery(delivery_note: DataFrame, delivery_note_item: DataFrame,
                  only: DataFrame | None = None) -> DataFrame:
    """J8 + J9 + A5 (+ F15's ``dn.docstatus = 1``): last submitted delivery
    date per order line; with ``only`` (a frame with ``soi_name``) items that
    can't be of its lines are cut first.  Lines without one drop out, as the WHERE does."""
    if only is not None:
        delivery_note_item = within(delivery_note_item, "so_detail", only, "soi_name")
    dn = flt.submitted_delivery_notes(delivery_note).select(
        F.col("name").alias("_dn"), F.col("posting_date").alias("_dn_date")
    )
    return (
        delivery_note_item.join(dn, F.col("parent") == F.col("_dn"))
        .groupBy(F.col("so_detail").alias("_so_detail"))
        .agg(F.max("_dn_date").alias("last_delivery_date"))
    )


def elapsed_by_order_item(lines: DataFrame, last: DataFrame) -> DataFrame:
    """A6 (+ X4): seconds from order date to last delivery per (order, item);
    of several lines the one with the greatest line name wins (the
    reference's ordered dict is overwritten in ``so.name, soi.name`` order)."""
    per_line = lines.join(last, F.col("soi_name") == F.col("_so_detail")).select(
        "sales_order",
        F.col("item_code").alias("so_item_code"),
        "soi_name",
        seconds_between(F.col("last_delivery_date"), F.col("transaction_date")).alias("elapsed_seconds"),
    )
    return per_line.groupBy("sales_order", "so_item_code").agg(
        F.max_by("elapsed_seconds", "soi_name").alias("elapsed_seconds")
    )
