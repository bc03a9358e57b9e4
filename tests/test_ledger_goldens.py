"""Goldens G1-G4 (FIXTURES.md §3): every ledger rule on hand-made rows."""

import pytest

from tally.plans import reports as rep
from tally.plans.params import LedgerParams, ReportError

from fixtures import golden_tables

PERIOD = ("2024-02-01", "2024-02-29")
MONEY = ("opening_balance", "invoiced_amount", "return_amount", "paid_amount", "closing_balance")


def rows(df, cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


@pytest.fixture(scope="module")
def tables(spark):
    return golden_tables(spark)


def test_g1_financial_status(tables):
    df = rep.customer_financial_status(tables, LedgerParams.of(*PERIOD, company="C1"))
    assert rows(df, ("customer_name",) + MONEY) == [
        ("Alpha", 107.0, 50.0, 20.0, 30.0, 107.0),
        ("Beta", 0.0, 40.0, 0.0, 48.0, -8.0),
        (None, 0.0, 5.0, 0.0, 0.0, 5.0),
        ("Delta", 0.0, 20.0, 0.0, 0.0, 20.0),
    ]
    assert {r.currency for r in df.collect()} == {"EGP"}


def test_g1_total_row(tables):
    df = rep.customer_financial_status(tables, LedgerParams.of(*PERIOD, company="C1"), with_total=True)
    got = rows(df, ("customer_name",) + MONEY + ("is_total",))
    assert got[-1] == (None, 107.0, 115.0, 20.0, 78.0, 124.0, 1)
    assert [r[0] for r in got[:-1]] == ["Alpha", "Beta", None, "Delta"]
    detail = got[:-1]
    for i in range(1, 6):
        assert sum(r[i] for r in detail) == got[-1][i]


def test_g1_balance_summary_has_blank_sales(tables):
    df = rep.customer_balance_summary(tables, LedgerParams.of(*PERIOD, company="C1"))
    assert df.columns[:3] == ["customer_name", "opening_balance", "sales"]
    assert df.schema["sales"].dataType.simpleString() == "string"
    assert {r.sales for r in df.collect()} == {None}
    assert df.schema["opening_balance"].metadata["label"]
    r1 = rep.customer_financial_status(tables, LedgerParams.of(*PERIOD, company="C1"))
    assert rows(df.drop("sales"), ("customer_name",) + MONEY) == rows(r1, ("customer_name",) + MONEY)


def test_g2_customer_filter(tables):
    df = rep.customer_financial_status(tables, LedgerParams.of(*PERIOD, company="C1", customer="Alpha"))
    assert rows(df, ("customer_name",) + MONEY) == [("Alpha", 107.0, 50.0, 20.0, 30.0, 107.0)]


def test_g3_receipts(tables):
    df = rep.customer_receipts(tables, LedgerParams.of(*PERIOD, company="C1"))
    assert rows(df, ("customer_name", "posting_date", "paid_amount")) == [
        ("Beta", "2024-02-03", 48.0),
        ("Alpha", "2024-02-05", 30.0),
        (None, "2024-02-06", 0.0),
        ("Delta", "2024-02-08", 0.0),
    ]
    alpha = [r for r in df.collect() if r.customer_name == "Alpha"][0]
    assert (alpha.opening_balance, alpha.invoiced_amount, alpha.return_amount, alpha.closing_balance) == (
        7.0, 50.0, 20.0, 7.0)


def test_g3_receipts_total(tables):
    df = rep.customer_receipts(tables, LedgerParams.of(*PERIOD, company="C1"), with_total=True)
    last = df.collect()[-1]
    # only numeric columns are totalled: the total row has no date
    assert last.is_total == 1 and last.paid_amount == 78.0 and last.posting_date is None


def test_g4_finance_book(tables):
    df = rep.customer_receipts(tables, LedgerParams.of(*PERIOD, company="C1", finance_book="FB-1"))
    got = {r.customer_name: r for r in df.collect()}
    assert got["Alpha"].paid_amount == 0.0 and got["Alpha"].closing_balance == 37.0
    assert got["Beta"].paid_amount == 48.0


def test_zero_suppression_drops_eps(tables):
    df = rep.customer_financial_status(tables, LedgerParams.of(*PERIOD, company="C1"))
    assert "Eps" not in {r.customer_name for r in df.collect()}


def test_closing_identity(tables):
    df = rep.customer_financial_status(tables, LedgerParams.of("2024-01-01", "2024-03-31"))
    for r in df.collect():
        assert r.closing_balance == pytest.approx(
            r.opening_balance + r.invoiced_amount - r.return_amount - r.paid_amount)


def test_supplier_side_names_by_code(tables):
    df = rep.customer_financial_status(
        tables, LedgerParams.of(*PERIOD, company="C1", party_type="Supplier"))
    assert rows(df, ("customer_name",) + MONEY) == [("A1", 0.0, 3.0, 0.0, 0.0, 3.0)]


def test_adjustments_after_suppression(spark, tables):
    from decimal import Decimal

    from tally.sources.schemas import SCHEMAS
    adj = spark.createDataFrame(
        [("Alpha", "Write Off", Decimal(5)), ("Alpha", "Round-Off", Decimal(1)),
         (None, "Write Off", Decimal(2)), ("Eps", "Write Off", Decimal(9))],
        SCHEMAS["party_adjustment"])
    t = tables.replace(party_adjustment=adj)
    df = rep.customer_status_with_adjustments(t, LedgerParams.of(*PERIOD, company="C1"),
                                              ["Write Off", "Round-Off"])
    got = {r.customer_name: r for r in df.collect()}
    assert "Eps" not in got  # suppressed before adjustments apply
    assert got["Alpha"].paid_amount == 24.0
    assert (got["Alpha"].adj_write_off, got["Alpha"].adj_round_off) == (5.0, 1.0)
    assert got[None].paid_amount == -2.0 and got[None].adj_write_off == 2.0
    assert got["Beta"].adj_write_off == 0.0


def test_equal_dates_allowed_and_reversed_rejected(tables):
    rep.customer_financial_status(tables, LedgerParams.of("2024-02-05", "2024-02-05")).collect()
    with pytest.raises(ReportError):
        LedgerParams.of("2024-02-06", "2024-02-05")


def test_input_order_does_not_matter(spark, tables):
    from fixtures import GL
    t2 = golden_tables(spark, gl_entry=list(reversed(GL)))
    p = LedgerParams.of(*PERIOD, company="C1")
    cols = ("customer_name",) + MONEY
    assert rows(rep.customer_financial_status(t2, p), cols) == rows(
        rep.customer_financial_status(tables, p), cols)


def test_collation_matches_codes_like_the_database(spark):
    from fixtures import GL, MAPPING
    # mapping codes differ from the ledger's parties in case and trailing blanks
    mapping = [(c.lower() + " ", n) for c, n in MAPPING]
    t = golden_tables(spark, customer_mapping=mapping)
    p = LedgerParams.of(*PERIOD, company="C1")
    binary = rep.customer_financial_status(t, p).collect()
    assert [r.customer_name for r in binary] == [None]  # nothing maps byte-for-byte
    ci = rep.customer_financial_status(t.with_collation("UNICODE_CI_AI_RTRIM"), p)
    assert rows(ci, ("customer_name",) + MONEY) == [
        ("Alpha", 107.0, 50.0, 20.0, 30.0, 107.0),
        ("Beta", 0.0, 40.0, 0.0, 48.0, -8.0),
        (None, 0.0, 5.0, 0.0, 0.0, 5.0),
        ("Delta", 0.0, 20.0, 0.0, 0.0, 20.0),
    ]
    assert GL  # same ledger as G1


def test_empty_ledger_has_no_total_row(tables):
    p = LedgerParams.of("2030-01-01", "2030-01-31", company="C9")
    assert rep.customer_financial_status(tables, p, with_total=True).count() == 0


def test_adjustments_with_total_row(spark, tables):
    from decimal import Decimal

    from tally.sources.schemas import SCHEMAS
    adj = spark.createDataFrame(
        [("Alpha", "Write Off", Decimal(5)), (None, "Write Off", Decimal(2))],
        SCHEMAS["party_adjustment"])
    t = tables.replace(party_adjustment=adj)
    rows = rep.customer_status_with_adjustments(
        t, LedgerParams.of(*PERIOD, company="C1"), ["Write Off"], with_total=True).collect()
    total = rows[-1]
    assert total.is_total == 1
    # the NULL customer's adjustment applies to the NULL group only, once
    assert total.paid_amount == 78.0 - 5 - 2 and total.adj_write_off == 7.0
    assert sum(r.paid_amount for r in rows[:-1]) == total.paid_amount
