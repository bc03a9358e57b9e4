"""ERP-shaped tables derived from the driver's TPC-H-style parquet.

The reference reads ledger and sales-order tables; the test data is a star
schema.  These derived frames (FIXTURES.md §2) give every rule of the reports
something to bite on: shared customer names, unmapped codes, returns,
cancelled and draft entries, opening flags, finance books, grades and
deliveries.  They are plain lazy DataFrame plans over the given tables, so
their work grows with the data and every filter a report puts on them is
pushed through to the parquet scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.functions import as_date, money
from tally.sources.tables import ErpTables, from_frames

# Fixed values of the derivation (FIXTURES.md §2), stated together.
GRADE_ATTRIBUTE = "الدرجة"
UNMAPPED_EVERY = 20          # c_custkey % 20 = 0 has no mapping row
OPENING_EVERY = 25           # o_orderkey % 25 = 0 is flagged is_opening = 'Yes'
CANCELLED_EVERY = 13         # o_orderkey % 13 = 0 is cancelled
DRAFT_ORDER_EVERY = 17       # o_orderkey % 17 = 0 is a cancelled (docstatus 2) order
CANCELLED_LINENUMBER = 7     # ledger lines of l_linenumber 7 are docstatus 2
UNGRADED_EVERY = 10          # p_partkey % 10 = 0 has no grade
ADJUSTED_EVERY = 10          # adjustments come from o_orderkey % 10 = 0
CURRENCY_ASIA, CURRENCY_OTHER = "EGP", "USD"
SUPPLIER_COMPANY = "ASIA"

TPCH_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def _txt(c: str | F.Column) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _key(prefix: str, *cols: str) -> F.Column:
    parts: list[F.Column] = [F.lit(prefix)]
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit("-"))
        parts.append(_txt(c))
    return F.concat(*parts)


def customer_company(customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """c_custkey -> company (the region name of the customer's nation).

    nation and region have a fixed size (25 and 5 rows at every scale), so
    broadcasting them is bounded.
    """
    geo = F.broadcast(
        nation.select("n_nationkey", "n_regionkey")
        .join(region.select("r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_nationkey", F.col("r_name").alias("company"))
    )
    return customer.select("c_custkey", "c_nationkey").join(
        geo, F.col("c_nationkey") == F.col("n_nationkey")
    ).select("c_custkey", "company")


def company(region: DataFrame) -> DataFrame:
    return region.select(
        F.col("r_name").alias("name"),
        F.when(F.col("r_name") == "ASIA", F.lit(CURRENCY_ASIA))
        .otherwise(F.lit(CURRENCY_OTHER)).alias("default_currency"),
    )


def customer_mapping(customer: DataFrame) -> DataFrame:
    """Two codes per name ('Party-' + c_custkey div 2); every 20th code unmapped."""
    return customer.where(F.col("c_custkey") % UNMAPPED_EVERY != 0).select(
        _key("CUST-", "c_custkey").alias("customer_code"),
        F.concat(F.lit("Party-"), _txt(F.expr("c_custkey div 2"))).alias("customer_name"),
    )


def sales_invoice(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    invoices = orders.select(
        _key("SINV-", "o_orderkey").alias("name"),
        F.lit(1).alias("docstatus"),
        F.lit(0).alias("is_return"),
        as_date("o_orderdate").alias("posting_date"),
    )
    returns = (
        lineitem.where(F.col("l_returnflag") == "R")
        .groupBy("l_orderkey")
        .agg(F.max(as_date("l_shipdate")).alias("posting_date"))
        .select(
            _key("SRET-", "l_orderkey").alias("name"),
            F.lit(1).alias("docstatus"),
            F.lit(1).alias("is_return"),
            "posting_date",
        )
    )
    return invoices.unionByName(returns)


def gl_entry(orders: DataFrame, lineitem: DataFrame, cust_company: DataFrame) -> DataFrame:
    """Ledger: a debit per order, a credit per returned / paid line, supplier credits."""
    null_s = F.lit(None).cast("string")
    orders_co = orders.join(cust_company, F.col("o_custkey") == F.col("c_custkey"), "left")
    key = F.col("o_orderkey")
    invoices = orders_co.select(
        as_date("o_orderdate").alias("posting_date"),
        F.lit("Customer").alias("party_type"),
        _key("CUST-", "o_custkey").alias("party"),
        F.lit("Sales Invoice").alias("voucher_type"),
        _key("SINV-", "o_orderkey").alias("voucher_no"),
        null_s.alias("against_voucher_type"),
        null_s.alias("against_voucher"),
        money("o_totalprice").alias("debit"),
        money(F.lit(0)).alias("credit"),
        F.when(key % OPENING_EVERY == 0, "Yes").otherwise("No").alias("is_opening"),
        F.lit(1).alias("docstatus"),
        F.when(key % CANCELLED_EVERY == 0, 1).otherwise(0).alias("is_cancelled"),
        F.col("company"),
        F.when(key % 3 == 0, "FB-1").when(key % 3 == 1, "FB-2").alias("finance_book"),
    )
    is_ret = F.col("l_returnflag") == "R"
    credits = (
        lineitem.where(F.col("l_returnflag").isin("R", "A"))
        .join(orders_co.select("o_orderkey", "o_custkey", "company"),
              F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            as_date("l_shipdate").alias("posting_date"),
            F.lit("Customer").alias("party_type"),
            _key("CUST-", "o_custkey").alias("party"),
            F.when(is_ret, "Sales Invoice").otherwise("Payment Entry").alias("voucher_type"),
            F.concat(F.when(is_ret, "SRET-").otherwise("PAY-"), _txt("l_orderkey")).alias("voucher_no"),
            null_s.alias("against_voucher_type"),
            null_s.alias("against_voucher"),
            money(F.lit(0)).alias("debit"),
            money("l_extendedprice").alias("credit"),
            F.lit("No").alias("is_opening"),
            F.when(F.col("l_linenumber") == CANCELLED_LINENUMBER, 2).otherwise(1).alias("docstatus"),
            F.lit(0).alias("is_cancelled"),
            F.col("company"),
            null_s.alias("finance_book"),
        )
    )
    supplier = lineitem.where(F.col("l_returnflag") == "N").select(
        as_date("l_shipdate").alias("posting_date"),
        F.lit("Supplier").alias("party_type"),
        _key("SUPP-", "l_suppkey").alias("party"),
        F.lit("Purchase Invoice").alias("voucher_type"),
        _key("PINV-", "l_orderkey").alias("voucher_no"),
        null_s.alias("against_voucher_type"),
        null_s.alias("against_voucher"),
        money(F.lit(0)).alias("debit"),
        money("l_extendedprice").alias("credit"),
        F.lit("No").alias("is_opening"),
        F.lit(1).alias("docstatus"),
        F.lit(0).alias("is_cancelled"),
        F.lit(SUPPLIER_COMPANY).alias("company"),
        null_s.alias("finance_book"),
    )
    return invoices.unionByName(credits).unionByName(supplier)


def sales_order(orders: DataFrame, cust_company: DataFrame) -> DataFrame:
    key, st = F.col("o_orderkey"), F.col("o_orderstatus")
    status = (
        F.when(st == "F", "Completed")
        .when(st == "O", "To Deliver and Bill")
        .when(st == "P", F.when(key % 3 == 0, "On Hold").when(key % 3 == 1, "Closed").otherwise("Stopped"))
    )
    return orders.join(cust_company, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        _key("SO-", "o_orderkey").alias("name"),
        _key("CUST-", "o_custkey").alias("customer"),
        as_date("o_orderdate").alias("transaction_date"),
        status.alias("status"),
        F.when(key % DRAFT_ORDER_EVERY == 0, 2).otherwise(1).alias("docstatus"),
        F.col("company"),
    )


def sales_order_item(lineitem: DataFrame) -> DataFrame:
    """An order line is the group (l_orderkey, l_linenumber); that pair repeats."""
    return lineitem.groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").alias("partkey"),
        F.min(as_date("l_shipdate")).alias("delivery_date"),
        F.sum("l_quantity").alias("qty"),
        F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(F.lit(0.0))).alias("delivered_qty"),
        F.sum(money("l_extendedprice")).cast("double").alias("base_amount"),
    ).select(
        _key("SOI-", "l_orderkey", "l_linenumber").alias("name"),
        _key("SO-", "l_orderkey").alias("parent"),
        _key("ITEM-", "partkey").alias("item_code"),
        "delivery_date", "qty", "delivered_qty", "base_amount",
    )


def sales_invoice_item(lineitem: DataFrame) -> DataFrame:
    return lineitem.where(F.col("l_returnflag") != "R").select(
        _key("SOI-", "l_orderkey", "l_linenumber").alias("so_detail"),
        F.col("l_quantity").alias("qty"),
        F.when(F.col("l_linestatus") == "F", 1).otherwise(2).alias("docstatus"),
    )


def item_variant_attribute(part: DataFrame) -> DataFrame:
    grades = part.where(F.col("p_partkey") % UNGRADED_EVERY != 0).select(
        _key("ITEM-", "p_partkey").alias("parent"),
        F.lit(GRADE_ATTRIBUTE).alias("attribute"),
        F.col("p_brand").alias("attribute_value"),
    )
    sizes = part.select(
        _key("ITEM-", "p_partkey").alias("parent"),
        F.lit("size").alias("attribute"),
        _txt("p_size").alias("attribute_value"),
    )
    return grades.unionByName(sizes)


def delivery_note(lineitem: DataFrame) -> DataFrame:
    return (
        lineitem.where(F.col("l_linestatus") == "F")
        .groupBy("l_orderkey", "l_linenumber", "l_suppkey")
        .agg(F.max(as_date("l_shipdate")).alias("posting_date"))
        .select(
            _key("DN-", "l_orderkey", "l_linenumber", "l_suppkey").alias("name"),
            "posting_date",
            F.lit(1).alias("docstatus"),
        )
    )


def delivery_note_item(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        _key("DN-", "l_orderkey", "l_linenumber", "l_suppkey").alias("parent"),
        _key("SOI-", "l_orderkey", "l_linenumber").alias("so_detail"),
    )


def party_adjustment(lineitem: DataFrame, orders: DataFrame, mapping: DataFrame) -> DataFrame:
    """Write-off / round-off amounts per customer name (op A8's input)."""
    lines = lineitem.where(
        (F.col("l_returnflag") == "A")
        & F.col("l_linenumber").isin(1, 2)
        & (F.col("l_orderkey") % ADJUSTED_EVERY == 0)
    )
    return (
        lines.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(mapping, _key("CUST-", "o_custkey") == F.col("customer_code"), "left")
        .groupBy(
            "customer_name",
            F.when(F.col("l_linenumber") == 1, "Write Off").otherwise("Round-Off").alias("account"),
        )
        .agg(money(F.sum("l_quantity")).alias("amount"))
    )


def erp_tables(spark: SparkSession, sf_dir: str) -> ErpTables:
    """All ERP tables, derived lazily from the parquet under ``sf_dir``.

    Nothing is read until a report touches a table; shared inputs (the
    source frames, customer -> company, the mapping) are built once.
    """
    memo: dict[str, DataFrame] = {}

    def once(key: str, build) -> DataFrame:
        if key not in memo:
            memo[key] = build()
        return memo[key]

    def src(name: str) -> DataFrame:
        return once(name, lambda: spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))

    def cc() -> DataFrame:
        return once("_cc", lambda: customer_company(src("customer"), src("nation"), src("region")))

    def mapping() -> DataFrame:
        return once("_mapping", lambda: customer_mapping(src("customer")))

    return from_frames(
        spark,
        gl_entry=lambda: gl_entry(src("orders"), src("lineitem"), cc()),
        customer_mapping=mapping,
        sales_invoice=lambda: sales_invoice(src("orders"), src("lineitem")),
        sales_order=lambda: sales_order(src("orders"), cc()),
        sales_order_item=lambda: sales_order_item(src("lineitem")),
        sales_invoice_item=lambda: sales_invoice_item(src("lineitem")),
        item_variant_attribute=lambda: item_variant_attribute(src("part")),
        delivery_note=lambda: delivery_note(src("lineitem")),
        delivery_note_item=lambda: delivery_note_item(src("lineitem")),
        company=lambda: company(src("region")),
        party_adjustment=lambda: party_adjustment(src("lineitem"), src("orders"), mapping()),
    )
