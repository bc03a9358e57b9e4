"""Oracle SQL (DuckDB) for every registered query.

Stated from the rules of SURVEY §1: a ledger entry gets one bucket and the
buckets are summed with ``FILTER``; an order line has one billed sum, a number
of names and a number of grades, whose product is what joining them all
would add up to; a line's last delivery is found first, then the last line of
each (order, item).  Parameters are the fixed values of
``tally.plans.queries``.
"""

from __future__ import annotations

from tally.checks.oracle_views import GRADE_ATTRIBUTE, with_views
from tally.plans.queries import (
    AS_OF,
    CLOCK,
    COMPANY,
    CUSTOMER,
    FINANCE_BOOK,
    FROM_DATE,
    ITEM,
    TO_DATE,
)

# The month before CLOCK, as the forms count it.
D_CLOCK, D_MONTH = f"DATE '{CLOCK}'", f"CAST(DATE '{CLOCK}' - INTERVAL 1 MONTH AS DATE)"
D_FROM, D_TO, D_ASOF = f"DATE '{FROM_DATE}'", f"DATE '{TO_DATE}'", f"DATE '{AS_OF}'"


MONEY = "opening_balance invoiced_amount return_amount paid_amount closing_balance"

RETURNED = f"""
    SELECT DISTINCT name AS returned_voucher FROM sales_invoice
    WHERE is_return = 1 AND docstatus = 1 AND posting_date >= {D_FROM}"""


def _entries(*, period_only: bool = False, finance_book: str | None = None, party_type: str = "Customer",
             date_from: str = D_FROM, date_to: str = D_TO) -> str:
    """One row per entry (and mapped name) with its signed amount and bucket."""
    signed = "debit - credit" if party_type == "Customer" else "credit - debit"
    since = f" AND posting_date >= {date_from}" if period_only else ""
    book = f" AND (finance_book IS NULL OR finance_book IN ('', '{finance_book}'))" if finance_book else ""
    names = ("LEFT JOIN customer_mapping ON customer_code = party" if party_type == "Customer"
             else "CROSS JOIN (SELECT 1)")
    name = "customer_name" if party_type == "Customer" else "party AS customer_name"
    return f"""
        SELECT posting_date, party, {name}, voucher_type, voucher_no, debit, credit, is_opening, amount,
               CASE WHEN is_opening = 'Yes' OR posting_date < {date_from} THEN 'opening'
                    WHEN amount > 0 THEN 'invoiced'
                    WHEN returned_voucher IS NULL THEN 'paid'
                    ELSE 'return' END AS bucket
        FROM (SELECT *, {signed} AS amount FROM gl_entry
              WHERE company = '{COMPANY}' AND party_type = '{party_type}' AND LENGTH(party) > 0
                AND is_cancelled = 0 AND docstatus IN (0, 1)
                AND posting_date <= {date_to}{since}{book}) AS kept
        LEFT JOIN ({RETURNED.replace(D_FROM, date_from)}) AS returned ON returned_voucher = voucher_no
        {names}"""


def _ledger(*, customer: str | None = None, total: bool = False, **which) -> str:
    """R1 / R3 by customer name: the sums of the buckets, without all-zero rows."""
    def bucket(name: str, sign: str = "") -> str:
        return f"COALESCE({sign}SUM(amount) FILTER (WHERE bucket = '{name}'), 0)"

    one = f"WHERE customer_name = '{customer}'" if customer else ""
    rows = f"""
        SELECT customer_name, MIN(posting_date) AS first_posting_date,
               {bucket('opening')} AS opening_balance, {bucket('invoiced')} AS invoiced_amount,
               {bucket('return', '-')} AS return_amount, {bucket('paid', '-')} AS paid_amount,
               SUM(amount) AS closing_balance
        FROM ({_entries(**which)}) AS entries {one}
        GROUP BY customer_name"""
    shown = f"""
        SELECT * FROM ({rows}) AS summed
        WHERE opening_balance <> 0 OR invoiced_amount <> 0 OR return_amount <> 0 OR paid_amount <> 0"""
    currency = f"(SELECT MAX(default_currency) FROM company WHERE name = '{COMPANY}') AS currency"
    if not total:
        return f"SELECT *, {currency} FROM ({shown}) AS shown"
    sums = ", ".join(f"SUM({c}) AS {c}" for c in MONEY.split())
    return f"""
        SELECT *, {currency}, 0 AS is_total FROM ({shown}) AS shown
        UNION ALL BY NAME
        SELECT {sums}, {currency}, 1 AS is_total FROM ({shown}) AS shown HAVING COUNT(*) > 0"""


def _dbl(cols: str) -> str:
    return ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols.split())


def financial_status(total: bool = False, customer: str | None = None, **which) -> str:
    tot = ", is_total" if total else ""
    return with_views(f"SELECT customer_name, {_dbl(MONEY)}, currency{tot} "
                      f"FROM ({_ledger(total=total, customer=customer, **which)}) r")


def balance_summary(total: bool = False) -> str:
    tot = ", is_total" if total else ""
    return with_views(
        f"SELECT customer_name, CAST(opening_balance AS DOUBLE) AS opening_balance, "
        f"CAST(NULL AS VARCHAR) AS sales, "
        f"{_dbl('invoiced_amount return_amount paid_amount closing_balance')}, currency{tot} "
        f"FROM ({_ledger(total=total)}) r")


def receipts(total: bool = False, customer: str | None = None, finance_book: str | None = None) -> str:
    tot = ", is_total" if total else ""
    inner = _ledger(period_only=True, total=total, customer=customer, finance_book=finance_book)
    # the total row carries no date (only numeric columns are totalled)
    date = ("CASE WHEN is_total = 1 THEN NULL ELSE strftime(first_posting_date, '%Y-%m-%d') END"
            if total else "strftime(first_posting_date, '%Y-%m-%d')")
    return with_views(
        f"SELECT customer_name, {date} AS posting_date, "
        f"{_dbl('paid_amount opening_balance invoiced_amount return_amount closing_balance')}, "
        f"currency{tot} FROM ({inner}) r")


def supplier_summary() -> str:
    return with_views(f"SELECT customer_name AS party_name, {_dbl(MONEY)}, currency "
                      f"FROM ({_ledger(party_type='Supplier')}) r")


def with_adjustments() -> str:
    return with_views(f"""
        SELECT r.customer_name,
               CAST(r.opening_balance AS DOUBLE) AS opening_balance,
               CAST(r.invoiced_amount AS DOUBLE) AS invoiced_amount,
               CAST(r.return_amount AS DOUBLE) AS return_amount,
               CAST(r.paid_amount - COALESCE(a.total, 0) AS DOUBLE) AS paid_amount,
               CAST(r.closing_balance AS DOUBLE) AS closing_balance,
               r.currency,
               CAST(COALESCE(a.write_off, 0) AS DOUBLE) AS adj_write_off,
               CAST(COALESCE(a.round_off, 0) AS DOUBLE) AS adj_round_off
        FROM ({_ledger()}) r
        LEFT JOIN (
            SELECT customer_name, SUM(amount) AS total,
                   SUM(CASE WHEN account = 'Write Off' THEN amount END) AS write_off,
                   SUM(CASE WHEN account = 'Round-Off' THEN amount END) AS round_off
            FROM party_adjustment GROUP BY customer_name
        ) a ON r.customer_name IS NOT DISTINCT FROM a.customer_name""")


def _item_rows(grade: bool, item: str | None = None, customer: str | None = None,
               date_from: str = D_FROM, date_to: str = D_TO, as_of: str = D_ASOF) -> str:
    """R4 / R5 line by line.  Names, invoices and grades are counted apart; a
    line's billed quantity is its invoice sum once per name and per grade."""
    only_item = f"WHERE item_code = '{item}'" if item else ""
    only_name = f"WHERE customer_name = '{customer}'" if customer else ""
    named = "JOIN" if customer else "LEFT JOIN"
    grades = f"""
        LEFT JOIN (SELECT parent AS graded_item, MIN(attribute_value) AS grade, COUNT(*) AS grades
                   FROM item_variant_attribute WHERE attribute = '{GRADE_ATTRIBUTE}' GROUP BY ALL) AS graded
               ON graded_item = item_code""" if grade else ""
    times = "COALESCE(names, 1)" + (" * COALESCE(grades, 1)" if grade else "")
    return f"""
        SELECT transaction_date AS date, delivery_date, sales_order, status, customer_name, item_code,
               date_diff('day', delivery_date, {as_of}) AS delay_days, qty, delivered_qty,
               qty - delivered_qty AS pending_qty,
               CAST(COALESCE(invoiced * {times}, 0) AS DOUBLE) AS billed_qty,
               base_amount AS amount, company, soi_name{', grade' if grade else ''}
        FROM (SELECT name AS soi_name, parent AS sales_order, item_code, delivery_date, qty, delivered_qty, base_amount
              FROM sales_order_item {only_item}) AS lines
        JOIN (SELECT name AS sales_order, customer, transaction_date, status, company FROM sales_order
              WHERE docstatus = 1 AND status <> 'Stopped' AND status <> 'Closed' AND status <> 'On Hold'
                AND transaction_date BETWEEN {date_from} AND {date_to}) AS open_orders USING (sales_order)
        {named} (SELECT customer_code AS customer, MIN(customer_name) AS customer_name, COUNT(*) AS names
                 FROM customer_mapping {only_name} GROUP BY ALL) AS mapped USING (customer)
        LEFT JOIN (SELECT so_detail AS soi_name, SUM(qty) AS invoiced
                   FROM sales_invoice_item WHERE docstatus = 1 GROUP BY ALL) AS billed USING (soi_name){grades}"""


def item_sales(grade: bool, item: str | None = None, customer: str | None = None,
               total: bool = False) -> str:
    rows = _item_rows(grade, item, customer)
    if not total:
        return with_views(f"SELECT * FROM ({rows}) r")
    return with_views(f"""
        SELECT *, 0 AS is_total FROM ({rows}) r
        UNION ALL BY NAME
        SELECT SUM(qty) AS qty, 1 AS is_total FROM ({rows}) r HAVING COUNT(*) > 0""")


def item_display() -> str:
    return with_views(f"""
        SELECT customer_name, item_code, CAST(NULL AS VARCHAR) AS boxs, qty, grade
        FROM ({_item_rows(True)}) r""")


def elapsed_time(of_orders: str | None = None) -> str:
    """Each line's last submitted delivery, then the last line of an (order, item)."""
    chosen = f"AND sales_order IN (SELECT sales_order FROM ({of_orders}) AS report)" if of_orders else ""
    return with_views(f"""
        SELECT sales_order, so_item_code, elapsed_seconds
        FROM (SELECT line.parent AS sales_order, line.item_code AS so_item_code,
                     86400 * date_diff('day', ordered.transaction_date, delivered.last_day) AS elapsed_seconds,
                     ROW_NUMBER() OVER (PARTITION BY line.parent, line.item_code ORDER BY line.name DESC) AS from_last
              FROM (SELECT so_detail, MAX(posting_date) AS last_day
                    FROM (SELECT name AS note, posting_date FROM delivery_note WHERE docstatus = 1) AS submitted
                    JOIN (SELECT parent AS note, so_detail FROM delivery_note_item) AS items USING (note)
                    GROUP BY so_detail) AS delivered
              JOIN sales_order_item AS line ON line.name = delivered.so_detail
              JOIN sales_order AS ordered ON ordered.name = line.parent) AS ranked
        WHERE from_last = 1 {chosen}""")


def party_entries(period_only: bool) -> str:
    return with_views(f"""
        SELECT posting_date, party, customer_name, voucher_type, voucher_no,
               CAST(debit AS DOUBLE) AS debit, CAST(credit AS DOUBLE) AS credit, is_opening
        FROM ({_entries(period_only=period_only)}) AS entries""")


def classified_entries() -> str:
    return with_views(f"""
        SELECT posting_date, party, customer_name, voucher_no, CAST(amount AS DOUBLE) AS amount, bucket
        FROM ({_entries()}) AS entries""")


ORACLE_SQL: dict[str, str] = {
    "customer_financial_status": financial_status(),
    "customer_financial_status_for_customer": financial_status(customer=CUSTOMER),
    "customer_balance_summary": balance_summary(),
    "customer_receipts": receipts(),
    "customer_receipts_for_customer": receipts(customer=CUSTOMER),
    "customer_receipts_for_finance_book": receipts(finance_book=FINANCE_BOOK),
    "item_sales_for_period": item_sales(True),
    "item_sales_for_item": item_sales(True, item=ITEM),
    "item_sales_for_customer": item_sales(False, customer=CUSTOMER),
    "so_elapsed_time": elapsed_time(),
    "so_elapsed_time_for_report": elapsed_time(_item_rows(True)),
    "so_elapsed_time_for_item": elapsed_time(_item_rows(True, item=ITEM)),
    "customer_status_from_snapshot": financial_status(),
    "item_sales_key_cut": item_sales(True),
    "item_sales_for_item_key_cut": item_sales(True, item=ITEM),
    "gl_classified_entries_key_cut": classified_entries(),
    "customer_status_key_cut": financial_status(),
    "customer_status_clustered": financial_status(customer=CUSTOMER),
    "item_sales_in_order": with_views(
        "SELECT *, ROW_NUMBER() OVER (ORDER BY date, item_code NULLS FIRST, soi_name) AS position "
        f"FROM ({_item_rows(True)}) r"),
    "customer_status_found_accounts": with_adjustments(),
    "customer_status_default_period": financial_status(date_from=D_MONTH, date_to=D_CLOCK),
    "item_sales_default_period": with_views(
        f"SELECT * FROM ({_item_rows(True, date_from=D_MONTH, date_to=D_CLOCK, as_of=D_CLOCK)}) r"),
    "item_sales_no_filter": with_views(f"SELECT * FROM ({_item_rows(True)}) r WHERE FALSE"),
    "item_sales_co_located": item_sales(True),
    "customer_financial_status_with_total": financial_status(total=True),
    "customer_balance_summary_with_total": balance_summary(total=True),
    "customer_receipts_with_total": receipts(total=True),
    "item_sales_for_period_with_total": item_sales(True, total=True),
    "item_sales_for_customer_with_total": item_sales(False, customer=CUSTOMER, total=True),
    "gl_party_entries": party_entries(False),
    "gl_party_entries_in_period": party_entries(True),
    "gl_classified_entries": classified_entries(),
    "return_invoices": with_views(
        f"SELECT name FROM sales_invoice WHERE docstatus = 1 AND is_return = 1 "
        f"AND posting_date >= {D_FROM}"),
    "open_sales_orders": with_views(
        f"SELECT name, customer, transaction_date, status, company FROM sales_order "
        f"WHERE status NOT IN ('Stopped', 'Closed', 'On Hold') AND docstatus = 1 "
        f"AND transaction_date BETWEEN {D_FROM} AND {D_TO}"),
    "so_line_billed_qty": with_views("""
        SELECT soi.name AS soi_name, CAST(COALESCE(SUM(sii.qty), 0) AS DOUBLE) AS billed_qty
        FROM sales_order_item soi
        LEFT JOIN sales_invoice_item sii ON sii.so_detail = soi.name AND sii.docstatus = 1
        GROUP BY soi.name"""),
    "so_line_delivery_status": with_views(f"""
        SELECT name AS soi_name, item_code, delivery_date, qty, delivered_qty,
               qty - delivered_qty AS pending_qty,
               date_diff('day', delivery_date, {D_ASOF}) AS delay_days
        FROM sales_order_item"""),
    "item_grade": with_views(f"""
        SELECT parent AS item_code, MIN(attribute_value) AS grade
        FROM item_variant_attribute WHERE attribute = '{GRADE_ATTRIBUTE}' GROUP BY parent"""),
    "company_currency": with_views("SELECT name AS company, default_currency AS currency FROM company"),
    "supplier_ledger_summary": supplier_summary(),
    "customer_status_with_adjustments": with_adjustments(),
    "item_sales_display": item_display(),
}

# The displayed columns of reports already stated above.
ORACLE_SQL |= {
    "customer_status_display": (
        "SELECT customer_name, opening_balance, invoiced_amount, return_amount, paid_amount, closing_balance "
        f"FROM ({ORACLE_SQL['customer_financial_status']})"),
    "customer_receipts_display": (
        f"SELECT customer_name, posting_date, paid_amount FROM ({ORACLE_SQL['customer_receipts']})"),
    "item_sales_for_customer_display": (
        "SELECT customer_name, item_code, CAST(NULL AS VARCHAR) AS boxs, qty "
        f"FROM ({ORACLE_SQL['item_sales_for_customer']})"),
}
