"""Reports by name with the reference's filters dict."""

import pytest

from tally.plans.execute import execute
from tally.plans.params import ReportError

from fixtures import golden_tables


@pytest.fixture(scope="module")
def tables(spark):
    return golden_tables(spark)


def test_ledger_report_by_name(tables):
    df = execute(tables, "Customer Financial Status",
                 {"from_date": "2024-02-01", "to_date": "2024-02-29", "company": "C1"})
    rows = df.collect()
    assert rows[-1].is_total == 1 and rows[-1].paid_amount == 78.0
    assert [r.customer_name for r in rows[:-1]] == ["Alpha", "Beta", None, "Delta"]


def test_default_company_applies(tables):
    df = execute(tables, "Customer Receipts for Period",
                 {"from_date": "2024-02-01", "to_date": "2024-02-29"}, default_company="C1",
                 with_total=False, raw=True)
    assert {r.currency for r in df.collect()} == {"EGP"}


def test_item_report_by_name(tables):
    df = execute(tables, "Item Sales Report for Customer",
                 {"from_date": "2024-02-01", "to_date": "2024-02-29", "customer": "Alpha"},
                 as_of="2024-03-01", raw=True)
    rows = df.collect()
    assert [r.soi_name for r in rows[:-1]] == ["S1a", "S1b"] and rows[-1].qty == 12.0


def test_declared_columns_with_labels(tables):
    df = execute(tables, "Customer Receipts for Period",
                 {"from_date": "2024-02-01", "to_date": "2024-02-29", "company": "C1"})
    assert df.columns == ["customer_name", "posting_date", "paid_amount", "is_total"]
    assert all(df.schema[c].metadata["label"] for c in df.columns[:-1])


def test_empty_filters_and_errors(tables):
    assert execute(tables, "Item Sales Report for a Specified Period", {}, as_of="2024-03-01",
                   with_total=False).count() == 0
    with pytest.raises(ReportError):
        execute(tables, "Item Sales Report for a Specified Period", {"to_date": "2024-02-01"})
    with pytest.raises(ValueError, match="unknown report"):
        execute(tables, "No Such Report", {})
