"""The displayed columns of each report, in order, with their labels.

Column descriptors become ``StructField`` metadata (label, fieldtype,
options), so a caller can render the report without a side table.  Columns
the reference declares but never fills (``sales``, ``boxs``) are typed NULL
strings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The reports' column descriptors (fieldname, label, fieldtype, options).
CUSTOMER = ("customer_name", "اسم العميل", "Data", None)
OPENING = ("opening_balance", "رصيد بداية الفترة", "Currency", "currency")
YARN_SALES = ("sales", "مبيعات الغزل", "Data", None)
INVOICED = ("invoiced_amount", "اجمالي المنصرف", "Currency", "currency")
RETURNED = ("return_amount", "اجمالي المرتجع", "Currency", "currency")
PAID_STATUS = ("paid_amount", "اجمالي المتحصلات", "Currency", "currency")
PAID = ("paid_amount", "التحصيل", "Currency", "currency")
CLOSING = ("closing_balance", "الرصيد المفتوح", "Currency", "currency")
DATE = ("posting_date", "التاريخ", "Date", None)
CUSTOMER_LINK = ("customer_name", "اسم العميل", "Link", "Customer")
ITEM_LINK = ("item_code", "الصنف", "Link", "Item")
BOXES = ("boxs", "الصناديق", "Data", None)
QTY = ("qty", "الكمية", "Float", None)
GRADE = ("grade", "الدرجة", "Data", None)

DISPLAY: dict[str, tuple[tuple[str, str, str, str | None], ...]] = {
    "customer_financial_status": (CUSTOMER, OPENING, INVOICED, RETURNED, PAID_STATUS, CLOSING),
    "customer_balance_summary": (CUSTOMER, OPENING, YARN_SALES, INVOICED, RETURNED, PAID, CLOSING),
    "customer_receipts": (CUSTOMER, DATE, PAID),
    "item_sales_for_period": (CUSTOMER_LINK, ITEM_LINK, BOXES, QTY, GRADE),
    "item_sales_for_customer": (CUSTOMER_LINK, ITEM_LINK, BOXES, QTY),
}

# Declared by the reference but never filled.
UNFILLED = {"sales", "boxs"}


def display(df: DataFrame, report: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Select and label the displayed columns of ``report``; ``keep`` adds
    undisplayed columns after them (e.g. ``currency``, ``is_total``)."""
    cols = []
    for name, label, fieldtype, options in DISPLAY[report]:
        meta = {"label": label, "fieldtype": fieldtype}
        if options:
            meta["options"] = options
        col = F.lit(None).cast("string") if name in UNFILLED else F.col(name)
        cols.append(col.alias(name, metadata=meta))
    cols += [F.col(c) for c in keep if c in df.columns]
    return df.select(*cols)
