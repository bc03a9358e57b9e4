"""Plan checks on every registered query: built-in operators only, no
cartesian product, no nested-loop join, no Python evaluation, and the
report filters reach the parquet scans."""

import contextlib
import io

import pytest

from tally.operators import filters as flt
from tally.operators.keyset import within
from tally.plans import reports as rep
from tally.plans.params import OrderParams
from tally.plans.queries import QUERIES, STORING
from tally.sources.tpch_erp import erp_tables

from conftest import SF_SMALL

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "PythonUDF", "FlatMapGroupsInPandas", "MapInPandas")


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(STORING)))  # those have plan tests of their own
def test_no_forbidden_operators(spark, key):
    text = plan_text(QUERIES[key](spark, SF_SMALL))
    for op in FORBIDDEN:
        assert op not in text, f"{key}: {op} in plan"


def test_ledger_filters_reach_the_scan(spark):
    text = plan_text(QUERIES["customer_financial_status"](spark, SF_SMALL))
    assert "LessThan(o_orderdate,1999-01-01T00:00)" in text
    assert "EqualTo(r_name,ASIA)" in text
    # column pruning: the orders scan reads only what the ledger needs
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz>" in text


def test_receipts_period_reaches_the_scan(spark):
    text = plan_text(QUERIES["customer_receipts"](spark, SF_SMALL))
    assert "GreaterThanOrEqual(o_orderdate,1997-01-01T00:00)" in text


def test_ledger_scans_each_source_once(spark):
    text = plan_text(QUERIES["customer_financial_status"](spark, SF_SMALL))
    scans = [l for l in text.splitlines() if l.startswith("Location: InMemoryFileIndex") and "orders" in l]
    # invoices branch, credits branch (custkey lookup): two reads of orders, not four
    assert len(scans) == 2


def test_billed_is_pre_aggregated_before_the_join(spark):
    text = plan_text(QUERIES["item_sales_for_period"](spark, SF_SMALL))
    assert "partial_sum" in text


def _sections(text: str) -> list[str]:
    return text.split("\n\n")


def test_ledger_is_pre_aggregated_before_any_join(spark):
    text = plan_text(QUERIES["customer_financial_status"](spark, SF_SMALL))
    # a partial aggregate keyed by (party, voucher-to-look-up) over raw entries
    assert any("HashAggregate" in s and "Keys [2]: [party" in s and "partial_sum" in s
               for s in _sections(text))
    # no join of raw entries on their voucher number: the return lookup uses
    # the spread key of the pre-aggregated rows
    assert "keys [1]: [voucher_no" not in text.lower()
    assert any("Left keys [1]: [_jk" in s for s in _sections(text))


def test_no_row_is_copied_in_an_unskewed_plan(spark):
    for key in ("item_sales_for_period", "gl_classified_entries", "customer_financial_status"):
        assert ") Generate" not in plan_text(QUERIES[key](spark, SF_SMALL))


def test_ledger_totals_run_the_report_once(spark):
    plain, total = (plan_text(QUERIES[k](spark, SF_SMALL))
                    for k in ("customer_financial_status", "customer_financial_status_with_total"))
    for node in (") Scan parquet", "Join "):
        assert total.count(node) == plain.count(node), node


def executed(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]


def test_item_totals_copy_no_line(spark):
    """Executed plans: no Expand, and the total's branch carries quantities only."""
    for key in ("item_sales_for_period_with_total", "item_sales_for_customer_with_total"):
        text = executed(QUERIES[key](spark, SF_SMALL))
        assert "Expand" not in text and "Union" in text, key


def test_r6_of_a_report_shuffles_no_more_than_r6(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        whole, report, period, item, customer = (
            plan_text(QUERIES[k](spark, SF_SMALL)).count(") Exchange") for k in (
                "so_elapsed_time", "so_elapsed_time_for_report", "item_sales_for_period", "item_sales_for_item",
                "item_sales_for_customer"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert report <= whole
    assert item <= period and customer <= period


def test_large_tables_are_cut_before_the_shuffle(spark):
    """With the bitmap fewer invoice rows enter the aggregate, and fewer entries the return lookup."""
    for key, plain in (("item_sales_key_cut", "item_sales_for_period"), ("gl_classified_entries_key_cut", "gl_classified_entries")):
        cut_text, plain_text = (plan_text(QUERIES[k](spark, SF_SMALL)) for k in (key, plain))
        assert "bitmap_construct_agg" in cut_text and "bitmap_construct_agg" not in plain_text, key
    t = erp_tables(spark, SF_SMALL)
    p = OrderParams.of("1997-01-01", "1998-12-31")
    rows = flt.submitted_invoice_items(t.sales_invoice_item)
    left = within(rows, "so_detail", rep._listed_names(t, p, True), "soi_name").count()
    assert left < 0.5 * rows.count()
