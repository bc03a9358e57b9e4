"""DuckDB SQL for the ERP-shaped views derived from the driver's parquet.

This is the *oracle* side of the two-engine check: it is written as plain
SQL, independently of the DataFrame code in ``tally.sources.tpch_erp``, and
runs in DuckDB over the pre-registered tables ``region nation customer
supplier part orders lineitem``.  Each oracle query is ``WITH <views>
SELECT ...``; DuckDB drops the views a query does not use.
"""

from __future__ import annotations

# Fixed values shared with the Spark view builder (FIXTURES.md §2).
GRADE_ATTRIBUTE = "الدرجة"

VIEW_SQL: dict[str, str] = {
    "cust_company": """
        SELECT c.c_custkey, r.r_name AS company
        FROM customer c
        JOIN nation n ON c.c_nationkey = n.n_nationkey
        JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "company": """
        SELECT r_name AS name,
               CASE WHEN r_name = 'ASIA' THEN 'EGP' ELSE 'USD' END AS default_currency
        FROM region""",
    "customer_mapping": """
        SELECT 'CUST-' || CAST(c_custkey AS VARCHAR) AS customer_code,
               'Party-' || CAST(c_custkey // 2 AS VARCHAR) AS customer_name
        FROM customer
        WHERE c_custkey % 20 <> 0""",
    "sales_invoice": """
        SELECT 'SINV-' || CAST(o_orderkey AS VARCHAR) AS name, 1 AS docstatus,
               0 AS is_return, CAST(o_orderdate AS DATE) AS posting_date
        FROM orders
        UNION ALL
        SELECT 'SRET-' || CAST(l_orderkey AS VARCHAR), 1, 1, MAX(CAST(l_shipdate AS DATE))
        FROM lineitem WHERE l_returnflag = 'R'
        GROUP BY l_orderkey""",
    "gl_entry": """
        SELECT CAST(o.o_orderdate AS DATE) AS posting_date,
               'Customer' AS party_type,
               'CUST-' || CAST(o.o_custkey AS VARCHAR) AS party,
               'Sales Invoice' AS voucher_type,
               'SINV-' || CAST(o.o_orderkey AS VARCHAR) AS voucher_no,
               CAST(NULL AS VARCHAR) AS against_voucher_type,
               CAST(NULL AS VARCHAR) AS against_voucher,
               CAST(o.o_totalprice AS DECIMAL(21,9)) AS debit,
               CAST(0 AS DECIMAL(21,9)) AS credit,
               CASE WHEN o.o_orderkey % 25 = 0 THEN 'Yes' ELSE 'No' END AS is_opening,
               1 AS docstatus,
               CASE WHEN o.o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS is_cancelled,
               cc.company,
               CASE o.o_orderkey % 3 WHEN 0 THEN 'FB-1' WHEN 1 THEN 'FB-2' END AS finance_book
        FROM orders o LEFT JOIN cust_company cc ON o.o_custkey = cc.c_custkey
        UNION ALL
        SELECT CAST(l.l_shipdate AS DATE), 'Customer',
               'CUST-' || CAST(o.o_custkey AS VARCHAR),
               CASE WHEN l.l_returnflag = 'R' THEN 'Sales Invoice' ELSE 'Payment Entry' END,
               CASE WHEN l.l_returnflag = 'R' THEN 'SRET-' ELSE 'PAY-' END
                   || CAST(l.l_orderkey AS VARCHAR),
               NULL, NULL,
               CAST(0 AS DECIMAL(21,9)), CAST(l.l_extendedprice AS DECIMAL(21,9)),
               'No', CASE WHEN l.l_linenumber = 7 THEN 2 ELSE 1 END, 0,
               cc.company, NULL
        FROM lineitem l
        JOIN orders o ON l.l_orderkey = o.o_orderkey
        LEFT JOIN cust_company cc ON o.o_custkey = cc.c_custkey
        WHERE l.l_returnflag IN ('R', 'A')
        UNION ALL
        SELECT CAST(l_shipdate AS DATE), 'Supplier',
               'SUPP-' || CAST(l_suppkey AS VARCHAR),
               'Purchase Invoice', 'PINV-' || CAST(l_orderkey AS VARCHAR),
               NULL, NULL,
               CAST(0 AS DECIMAL(21,9)), CAST(l_extendedprice AS DECIMAL(21,9)),
               'No', 1, 0, 'ASIA', NULL
        FROM lineitem WHERE l_returnflag = 'N'""",
    "sales_order": """
        SELECT 'SO-' || CAST(o.o_orderkey AS VARCHAR) AS name,
               'CUST-' || CAST(o.o_custkey AS VARCHAR) AS customer,
               CAST(o.o_orderdate AS DATE) AS transaction_date,
               CASE WHEN o.o_orderstatus = 'F' THEN 'Completed'
                    WHEN o.o_orderstatus = 'O' THEN 'To Deliver and Bill'
                    WHEN o.o_orderstatus = 'P' THEN
                        CASE o.o_orderkey % 3 WHEN 0 THEN 'On Hold'
                                              WHEN 1 THEN 'Closed' ELSE 'Stopped' END
               END AS status,
               CASE WHEN o.o_orderkey % 17 = 0 THEN 2 ELSE 1 END AS docstatus,
               cc.company
        FROM orders o LEFT JOIN cust_company cc ON o.o_custkey = cc.c_custkey""",
    "sales_order_item": """
        SELECT 'SOI-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS name,
               'SO-' || CAST(l_orderkey AS VARCHAR) AS parent,
               'ITEM-' || CAST(MIN(l_partkey) AS VARCHAR) AS item_code,
               MIN(CAST(l_shipdate AS DATE)) AS delivery_date,
               SUM(l_quantity) AS qty,
               SUM(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS delivered_qty,
               CAST(SUM(CAST(l_extendedprice AS DECIMAL(21,9))) AS DOUBLE) AS base_amount
        FROM lineitem
        GROUP BY l_orderkey, l_linenumber""",
    "sales_invoice_item": """
        SELECT 'SOI-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS so_detail,
               l_quantity AS qty,
               CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END AS docstatus
        FROM lineitem WHERE l_returnflag <> 'R'""",
    "item_variant_attribute": f"""
        SELECT 'ITEM-' || CAST(p_partkey AS VARCHAR) AS parent,
               '{GRADE_ATTRIBUTE}' AS attribute, p_brand AS attribute_value
        FROM part WHERE p_partkey % 10 <> 0
        UNION ALL
        SELECT 'ITEM-' || CAST(p_partkey AS VARCHAR), 'size', CAST(p_size AS VARCHAR)
        FROM part""",
    "delivery_note": """
        SELECT 'DN-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR)
                   || '-' || CAST(l_suppkey AS VARCHAR) AS name,
               MAX(CAST(l_shipdate AS DATE)) AS posting_date, 1 AS docstatus
        FROM lineitem WHERE l_linestatus = 'F'
        GROUP BY l_orderkey, l_linenumber, l_suppkey""",
    "delivery_note_item": """
        SELECT 'DN-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR)
                   || '-' || CAST(l_suppkey AS VARCHAR) AS parent,
               'SOI-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS so_detail
        FROM lineitem""",
    "party_adjustment": """
        SELECT cm.customer_name,
               CASE WHEN l.l_linenumber = 1 THEN 'Write Off' ELSE 'Round-Off' END AS account,
               CAST(SUM(l.l_quantity) AS DECIMAL(21,9)) AS amount
        FROM lineitem l
        JOIN orders o ON l.l_orderkey = o.o_orderkey
        LEFT JOIN customer_mapping cm ON cm.customer_code = 'CUST-' || CAST(o.o_custkey AS VARCHAR)
        WHERE l.l_returnflag = 'A' AND l.l_linenumber IN (1, 2) AND o.o_orderkey % 10 = 0
        GROUP BY 1, 2""",
}


def with_views(body: str) -> str:
    """Prefix ``body`` with every view as a CTE (unused ones are pruned)."""
    ctes = ",\n".join(f"{name} AS ({sql}\n)" for name, sql in VIEW_SQL.items())
    return f"WITH {ctes}\n{body}"
