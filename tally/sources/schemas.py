"""Fixed schemas of the ERP tables the reports read (FIXTURES.md §1).

Every source frame is *conformed* on load: the declared columns are selected
in order and cast to the declared type, which also prunes every other column
at the scan.  Columns declared not-null that feed arithmetic are guarded
lazily with ``raise_error`` so a NULL fails the job (the reference would raise
on ``None - x``) without an extra action.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DataType,
    DateType,
    DecimalType,
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
)

S, D, I, F64 = StringType(), DateType(), IntegerType(), DoubleType()
M = DecimalType(21, 9)


def _schema(*fields: tuple[str, DataType, bool]) -> StructType:
    return StructType([StructField(n, t, nullable) for n, t, nullable in fields])


SCHEMAS: dict[str, StructType] = {
    "gl_entry": _schema(
        ("posting_date", D, False), ("party_type", S, False), ("party", S, True),
        ("voucher_type", S, True), ("voucher_no", S, True),
        ("against_voucher_type", S, True), ("against_voucher", S, True),
        ("debit", M, False), ("credit", M, False), ("is_opening", S, True),
        ("docstatus", I, False), ("is_cancelled", I, False),
        ("company", S, True), ("finance_book", S, True),
    ),
    "customer_mapping": _schema(("customer_code", S, False), ("customer_name", S, True)),
    "sales_invoice": _schema(
        ("name", S, False), ("docstatus", I, False), ("is_return", I, False),
        ("posting_date", D, False),
    ),
    "sales_order": _schema(
        ("name", S, False), ("customer", S, True), ("transaction_date", D, False),
        ("status", S, True), ("docstatus", I, False), ("company", S, True),
    ),
    "sales_order_item": _schema(
        ("name", S, False), ("parent", S, False), ("item_code", S, True),
        ("delivery_date", D, True), ("qty", F64, True), ("delivered_qty", F64, True),
        ("base_amount", F64, True),
    ),
    "sales_invoice_item": _schema(("so_detail", S, True), ("qty", F64, True), ("docstatus", I, False)),
    "item_variant_attribute": _schema(
        ("parent", S, False), ("attribute", S, False), ("attribute_value", S, True),
    ),
    "delivery_note": _schema(("name", S, False), ("posting_date", D, False), ("docstatus", I, False)),
    "delivery_note_item": _schema(("parent", S, False), ("so_detail", S, True)),
    "company": _schema(("name", S, False), ("default_currency", S, True)),
    "party_adjustment": _schema(("customer_name", S, True), ("account", S, False), ("amount", M, False)),
}

# Columns a stored layout may add (sources.buckets); kept where present.
OPTIONAL: dict[str, tuple[str, ...]] = {"sales_invoice_item": ("order_of_line",)}

# Not-null columns whose NULL would change a sum silently in SQL but fail in
# the reference's Python fold; checked lazily.  Filter columns are not
# wrapped, so their predicates still reach the scan.
GUARDED: dict[str, tuple[str, ...]] = {
    "gl_entry": ("debit", "credit"),
    "party_adjustment": ("amount",),
}


# Text columns the reference compares inside SQL, where the database's
# collation applies (case-, accent- and trailing-space-insensitive there).
# Columns it compares in Python (voucher numbers against the return list,
# the ``is_opening`` flag, the grouping by customer name) stay binary.
TEXT_KEYS: dict[str, tuple[str, ...]] = {
    "gl_entry": ("party_type", "party", "company", "finance_book"),
    "customer_mapping": ("customer_code", "customer_name"),
    "sales_order": ("name", "customer", "status", "company"),
    "sales_order_item": ("name", "parent", "item_code"),
    "sales_invoice_item": ("so_detail",),
    "item_variant_attribute": ("parent", "attribute"),
    "delivery_note": ("name",),
    "delivery_note_item": ("parent", "so_detail"),
    "company": ("name",),
}


def conform(df: DataFrame, table: str, collation: str | None = None) -> DataFrame:
    """Select the declared columns of ``table`` in order, cast to their types
    (and those a layout added).

    With ``collation`` (e.g. ``UNICODE_CI_AI_RTRIM``) the table's text keys
    carry that collation, so every join, filter and sort on them follows it.
    """
    schema = SCHEMAS[table]
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"{table}: missing columns {missing}")
    guarded = set(GUARDED.get(table, ()))
    cols = []
    for f in schema.fields:
        c = F.col(f.name).cast(f.dataType)
        if f.name in guarded:
            c = F.when(c.isNull(), F.raise_error(F.lit(f"{table}.{f.name} is NULL"))).otherwise(c)
        if collation and f.name in TEXT_KEYS.get(table, ()):
            c = F.collate(c, collation)
        cols.append(c.alias(f.name))
    return df.select(*cols, *[c for c in OPTIONAL.get(table, ()) if c in df.columns])
