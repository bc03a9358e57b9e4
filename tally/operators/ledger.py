"""Ledger operators: signed amounts, buckets, per-customer summary (P1, J1,
J2, A1-A3, A8).

Per ledger entry the reference decides one bucket:

* opening  - dated before the period, or flagged ``is_opening = 'Yes'``;
* invoiced - otherwise, a positive signed amount;
* return   - otherwise, the voucher is a return invoice (sign flipped);
* paid     - otherwise (sign flipped);

and closing is the sum of all signed amounts.  Rows are grouped by the
customer *name* of the party's mapping (unmapped parties form one NULL
group; a code mapped twice counts twice).

At scale the summary never joins raw entries to anything:

1. entries are pre-aggregated per ``(party, vkey)``, where ``vkey`` is the
   voucher number only for entries that still need the return lookup
   (in-period, not opening, amount <= 0) and NULL otherwise.  This is one
   partial + final hash aggregate, so a hot party or voucher is combined on
   the map side before any shuffle.  In a large ledger a voucher that can't be
   among the return names, by a bounded bitmap (``keyset``), isn't kept either:
   payments shrink to a row a party;
2. only those pre-aggregated rows meet the return-invoice names (a join, so
   the name list never goes through the driver; AQE broadcasts it when its
   measured size is under the threshold, and splits skewed partitions
   otherwise);
3. per-party sums are then joined to the mapping - one row per party, so no
   hot join key exists - and summed again by name.

All sums are over DECIMAL, so the staging cannot change a total.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.functions import adjustment_column, to_double, zero
from tally.operators.keyset import maybe_in, worth_cutting

MONEY_COLS = ("opening_balance", "invoiced_amount", "return_amount", "paid_amount", "closing_balance")


def signed_amount(party_type: str) -> Column:
    """A2: a customer's debit raises the balance; for other parties, credit does."""
    if party_type == "Customer":
        return F.col("debit") - F.col("credit")
    return F.col("credit") - F.col("debit")


def is_opening(from_date: dt.date) -> Column:
    """§1 item 3: before the period, or flagged opening (also inside it)."""
    return (F.col("posting_date") < F.lit(from_date)) | F.coalesce(F.col("is_opening") == "Yes", F.lit(False))


def with_customer_name(df: DataFrame, mapping: DataFrame, code_col: str = "party") -> DataFrame:
    """Left join to the mapping by code; duplicates fan out."""
    m = mapping.select(F.col("customer_code").alias("_code"), "customer_name")
    return df.join(m, F.col(code_col) == F.col("_code"), "left").drop("_code")


def flag_returns(df: DataFrame, returns: DataFrame, voucher_col: str, spread_col: str) -> DataFrame:
    """Adds boolean ``is_return`` = voucher is a return invoice.

    A left join to the names: ``name`` is the primary key of the invoices, so
    it never fans out, and both sides are plain shuffles, so AQE can split a
    hot voucher.  Rows whose voucher is NULL get the join key
    ``'\\0' + spread_col`` instead of NULL, so they hash across partitions
    rather than into one; the ``voucher IS NOT NULL`` join condition keeps
    them from ever matching.
    """
    names = returns.select(F.col("name").alias("_ret_name"), F.lit(True).alias("_hit"))
    voucher = F.col(voucher_col)
    spread = F.concat(F.lit("\u0000"), F.collate(F.col(spread_col), "UTF8_BINARY"))
    cond = (F.col("_jk") == F.col("_ret_name")) & voucher.isNotNull()
    return (
        df.withColumn("_jk", F.coalesce(voucher, spread)).join(names, cond, "left")
        .withColumn("is_return", F.coalesce(F.col("_hit"), F.lit(False)))
        .drop("_ret_name", "_hit", "_jk")
    )


def classify(entries: DataFrame, returns: DataFrame, from_date: dt.date, party_type: str) -> DataFrame:
    """P1 per entry: ``amount`` and ``bucket`` (opening/invoiced/return/paid).

    Raw entries meet the return names here; NULL vouchers are spread by party.
    Of a large ledger only those entries do whose bucket hangs on it and whose
    voucher may be a return (by the bitmap of the names): the others stay where they are.
    """
    amt = signed_amount(party_type)
    bucket = (
        F.when(is_opening(from_date), "opening")
        .when(F.col("amount") > 0, "invoiced")
        .when(F.col("is_return"), "return")
        .otherwise("paid")
    )
    signed = entries.withColumn("amount", amt)
    if not worth_cutting(entries):
        flagged = flag_returns(signed, returns, "voucher_no", spread_col="party")
        return flagged.withColumn("bucket", bucket).drop("is_return")
    marked = maybe_in(signed, "voucher_no", returns, "name", "_may")
    open_question = F.col("_may") & ~is_opening(from_date) & (F.col("amount") <= 0)
    looked_up = flag_returns(marked.where(open_question), returns, "voucher_no", spread_col="party")
    flagged = looked_up.unionByName(marked.where(~open_question).withColumn("is_return", F.lit(False))).drop("_may")
    return flagged.withColumn("bucket", bucket).drop("is_return")


def _party_sums(entries: DataFrame, returns: DataFrame, from_date: dt.date, party_type: str) -> DataFrame:
    """Steps 1-2 of the module plan: one row per party with the five buckets."""
    amt = signed_amount(party_type)
    opening = is_opening(from_date)
    lookup = ~opening & (amt <= 0)
    if worth_cutting(entries):
        marked = maybe_in(entries, "voucher_no", returns, "name", "_may")
    else:
        marked = entries.withColumn("_may", F.lit(True))
    pre = marked.groupBy(
        "party", F.when(lookup & F.col("_may"), F.col("voucher_no")).alias("vkey")
    ).agg(
        F.sum(F.when(opening, amt).otherwise(zero())).alias("opening_balance"),
        F.sum(F.when(~opening & (amt > 0), amt).otherwise(zero())).alias("invoiced_amount"),
        F.sum(F.when(lookup, -amt).otherwise(zero())).alias("credited"),
        F.sum(amt).alias("closing_balance"),
        F.min("posting_date").alias("first_posting_date"),
    )
    # Rows with no voucher to look up (one per party) are spread by party.
    flagged = flag_returns(pre, returns, "vkey", spread_col="party")
    ret = F.col("is_return")
    return flagged.groupBy("party").agg(
        F.sum("opening_balance").alias("opening_balance"),
        F.sum("invoiced_amount").alias("invoiced_amount"),
        F.sum(F.when(ret, F.col("credited")).otherwise(zero())).alias("return_amount"),
        F.sum(F.when(ret, zero()).otherwise(F.col("credited"))).alias("paid_amount"),
        F.sum("closing_balance").alias("closing_balance"),
        F.min("first_posting_date").alias("first_posting_date"),
    )


def opening_sums(balances: DataFrame, party_type: str) -> DataFrame:
    """Balances before the period (party, debit, credit, first_posting_date) as
    per-party sums: all of it is opening."""
    amount = signed_amount(party_type)
    nothing = zero()
    return balances.select(
        "party", amount.alias("opening_balance"), nothing.alias("invoiced_amount"), nothing.alias("return_amount"),
        nothing.alias("paid_amount"), amount.alias("closing_balance"), "first_posting_date")


def ledger_summary(entries: DataFrame, returns: DataFrame, mapping: DataFrame | None,
                   from_date: dt.date, party_type: str = "Customer", before: DataFrame | None = None) -> DataFrame:
    """A1 + A3: one row per customer name.

    ``mapping=None`` names each party by its own code (supplier side).
    ``before`` holds the balances of the entries that ``entries`` leaves out,
    all dated before the period (``sources.snapshots``).
    Columns: customer_name, the five money buckets (DECIMAL),
    first_posting_date.
    """
    per_party = _party_sums(entries, returns, from_date, party_type)
    if before is not None:
        per_party = per_party.unionByName(opening_sums(before, party_type))
    return by_name(per_party, mapping)


def by_name(per_party: DataFrame, mapping: DataFrame | None) -> DataFrame:
    """J1 + A1 on per-party sums: one row per customer name."""
    if mapping is None:
        named = per_party.withColumn("customer_name", F.col("party"))
    else:
        named = with_customer_name(per_party, mapping, "party")
    # The reference groups in a Python dict: names compare binary even when
    # the tables carry a collation.
    named = named.withColumn("customer_name", F.collate("customer_name", "UTF8_BINARY"))
    aggs = [F.sum(c).alias(c) for c in MONEY_COLS] + [F.min("first_posting_date").alias("first_posting_date")]
    return named.groupBy("customer_name").agg(*aggs)


def adjustment_totals(adjustments: DataFrame, accounts: Sequence[str]) -> DataFrame:
    """A8 input: per customer name the total and one column per listed account.

    Conditional sums in one aggregate (the pivot over a given account list,
    without a job to discover the accounts).  Of accounts that share a column
    name the last one's sum is kept.
    """
    cols = [F.sum("amount").alias("_adj_total")]
    cols += [
        F.sum(F.when(F.col("account") == F.lit(a), F.col("amount"))).alias(c)
        for c, a in {adjustment_column(a): a for a in accounts}.items()
    ]
    return adjustments.groupBy(F.col("customer_name").alias("_adj_name")).agg(*cols)


MOST_ACCOUNTS = 1000


def found_accounts(adjustments: DataFrame, most: int = MOST_ACCOUNTS) -> list[str]:
    """The accounts that occur, in order: they become columns, so their number
    is bounded and more than ``most`` raise.  One small job, combined map-side."""
    rows = adjustments.select(F.collate("account", "UTF8_BINARY").alias("account")).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} adjustment accounts")
    return sorted(r.account for r in rows)


def adjustment_maps(adjustments: DataFrame) -> DataFrame:
    """A8 input without an account list: per customer name the total and the
    map account -> sum.  Amounts are summed per (name, account) first, so a
    map has one entry an account however many rows a name has."""
    sums = adjustments.groupBy(F.col("customer_name").alias("_adj_name"), "account").agg(F.sum("amount").alias("amount"))
    return sums.groupBy("_adj_name").agg(
        F.sum("amount").alias("_adj_total"),
        F.map_from_entries(F.collect_list(F.struct("account", "amount"))).alias("_adj_by_account"))


def apply_found_adjustments(summary: DataFrame, adjustments: DataFrame) -> DataFrame:
    """A8 with a column for every account that occurs in ``adjustments``, as
    the reference makes them; otherwise :func:`apply_adjustments`."""
    by_column = {adjustment_column(a): a for a in found_accounts(adjustments)}
    adj = adjustment_maps(adjustments)
    joined = summary.join(adj, summary["customer_name"].eqNullSafe(adj["_adj_name"]), "left")
    out = joined.withColumn("paid_amount", F.col("paid_amount") - F.coalesce(F.col("_adj_total"), zero()))
    columns = {c: F.coalesce(F.try_element_at("_adj_by_account", F.lit(a)), zero()) for c, a in by_column.items()}
    return out.withColumns(columns).drop("_adj_name", "_adj_total", "_adj_by_account")


def apply_adjustments(summary: DataFrame, adjustments: DataFrame, accounts: Sequence[str]) -> DataFrame:
    """Subtract each customer's adjustment total from ``paid_amount`` and
    add ``adj_<account>`` columns (0 when absent).  Run after zero suppression.
    The join is null-safe, so the NULL customer group gets its adjustments too.
    """
    adj = adjustment_totals(adjustments, accounts)
    joined = summary.join(adj, summary["customer_name"].eqNullSafe(adj["_adj_name"]), "left")
    out = joined.withColumn("paid_amount", F.col("paid_amount") - F.coalesce(F.col("_adj_total"), zero()))
    for c in dict.fromkeys(adjustment_column(a) for a in accounts):
        out = out.withColumn(c, F.coalesce(F.col(c), zero()))
    return out.drop("_adj_name", "_adj_total")


def money_to_double(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Report edge: DECIMAL sums out as DOUBLE."""
    return df.select(*[to_double(c).alias(c) if c in cols else F.col(c) for c in df.columns])
