"""Balance snapshots: same reports, less ledger read, back-dated entries caught."""

import contextlib
import datetime as dt
import io
import os
from pathlib import Path

import pytest

from tally.plans import reports as rep
from tally.plans.params import LedgerParams
from tally.sources.layout import write_monthly
from tally.sources.schemas import SCHEMAS
from tally.sources.snapshots import BalanceSnapshots, month_ends

from fixtures import d, gl_row, golden_tables

P = LedgerParams.of("2024-02-01", "2024-02-29", company="C1")


def explain(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def add(spark, ledger, *rows):
    write_monthly(spark.createDataFrame(list(rows), SCHEMAS["gl_entry"]).coalesce(1), ledger, mode="append")


@pytest.fixture
def store(spark, tmp_path):
    golden = golden_tables(spark)
    ledger = f"{tmp_path}/gl_entry"
    write_monthly(golden.gl_entry, ledger)
    snaps = BalanceSnapshots(spark, ledger, f"{tmp_path}/snapshots")
    return golden, snaps


def same(t, snaps, p=P, f=rep.customer_financial_status):
    plain, short = f(t.replace(gl_entry=lambda: snaps.entries()), p).collect(), f(t, p, snapshots=snaps).collect()
    assert plain == short and plain
    return plain


def test_month_ends():
    assert month_ends(d("2023-12-05"), d("2024-03-30")) == [d("2023-12-31"), d("2024-01-31"), d("2024-02-29")]
    assert month_ends(d("2024-01-31"), d("2024-01-31")) == [d("2024-01-31")] and month_ends(d("2024-01-02"), d("2024-01-30")) == []


def test_reports_are_the_same(store):
    t, snaps = store
    assert snaps.ends() == [] and snaps.stale_from() is None and snaps.usable(P.from_date) is None
    same(t, snaps)  # without any snapshot the history is read
    assert snaps.refresh(month_ends(d("2023-12-01"), d("2024-02-29"))) == [d("2023-12-31"), d("2024-01-31"), d("2024-02-29")]
    assert snaps.refresh(snaps.ends()) == []
    assert snaps.usable(P.from_date) == d("2024-01-31") and snaps.usable(d("2024-01-31")) == d("2023-12-31")
    for p in (LedgerParams.of("2024-01-06", "2024-02-29", company="C1"),
              LedgerParams.of("2024-02-01", "2024-02-29", company="C1", customer="Alpha"),
              LedgerParams.of("2024-02-01", "2024-02-29", party_type="Supplier")):
        plain = rep.customer_financial_status(t, p).collect()
        assert rep.customer_financial_status(t, p, snapshots=snaps).collect() == plain, p
    same(t, snaps, f=rep.customer_balance_summary)


def test_only_the_ledger_after_the_snapshot_is_read(store):
    t, snaps = store
    snaps.refresh([d("2024-01-31")])
    text = explain(rep.customer_financial_status(t, P, snapshots=snaps))
    filters = [x for x in text.splitlines() if x.startswith("PartitionFilters")]
    assert any("posting_month" in x and ">= 2024-02-01" in x and "<= 2024-02-29" in x for x in filters), filters
    assert any("period_end" in x and "= 2024-01-31" in x for x in filters), filters
    # by files: a ledger whose older months can't be read gives the same report
    want = rep.customer_financial_status(t, P).collect()
    for old in Path(snaps.ledger).glob("posting_month=2024-01-01/*.parquet"):
        stat = old.stat()
        old.write_bytes(bytes(stat.st_size))
        os.utime(old, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    assert rep.customer_financial_status(t, P, snapshots=snaps).collect() == want


def test_a_back_dated_entry_is_caught(spark, store):
    t, snaps = store
    snaps.refresh(month_ends(d("2023-12-01"), d("2024-02-29")))
    before = same(t, snaps)
    add(spark, snaps.ledger, gl_row("2024-01-10", "Customer", "A1", "SINV-X", 70))
    assert snaps.stale_from() == d("2024-01-01")
    assert snaps.usable(P.from_date) == d("2023-12-31")
    assert same(t, snaps) != before
    assert snaps.refresh(snaps.ends()) == [d("2024-01-31"), d("2024-02-29")]
    assert snaps.stale_from() is None and snaps.usable(P.from_date) == d("2024-01-31")
    same(t, snaps)
    add(spark, snaps.ledger, gl_row("2024-02-20", "Customer", "A1", "SINV-Y", 3), gl_row("2024-03-20", "Customer", "N", "SINV-Z", 3))
    assert snaps.stale_from() == d("2024-02-01") and snaps.usable(P.from_date) == d("2024-01-31")
    same(t, snaps)
    assert snaps.refresh([d("2024-02-15"), d("2024-03-31")]) == [d("2024-02-15"), d("2024-02-29"), d("2024-03-31")]
    assert snaps.usable(d("2024-02-20")) == d("2024-02-15")
    same(t, snaps, LedgerParams.of("2024-02-20", "2024-04-01"))


def test_a_period_that_empties_is_replaced(spark, tmp_path):
    golden = golden_tables(spark)
    ledger = f"{tmp_path}/gl_entry"
    add(spark, ledger, gl_row("2024-01-10", "Customer", "A1", "SINV-1", 100), gl_row("2024-02-10", "Customer", "A1", "SINV-2", 5))
    snaps = BalanceSnapshots(spark, ledger, f"{tmp_path}/snapshots")
    snaps.refresh([d("2024-01-31")])
    cancelled = spark.createDataFrame([gl_row("2024-01-10", "Customer", "A1", "SINV-1", 100, is_cancelled=1)], SCHEMAS["gl_entry"])
    write_monthly(cancelled, ledger, mode="overwrite")
    assert snaps.stale_from() == d("2024-01-01") and snaps.usable(P.from_date) is None
    snaps.refresh([d("2024-01-31")])
    assert snaps.balances(d("2024-01-31")).where("party is not null").count() == 0
    assert len(same(golden, snaps)) == 1


def test_random_ledger(spark, tmp_path):
    import random
    rng = random.Random(3)
    golden = golden_tables(spark)
    day = lambda: str(dt.date(2023, 11, 1) + dt.timedelta(days=rng.randrange(150)))
    rows = [gl_row(day(), rng.choice(["Customer", "Customer", "Supplier"]), rng.choice(["A1", "A2", "B1", "D1", "E1", "Z9", ""]),
                   rng.choice(["SINV-1", "SRET-1", "SRET-0", "PAY-1"]), rng.randrange(50), rng.randrange(50),
                   is_opening=rng.choice(["No", "No", "Yes"]), docstatus=rng.choice([0, 1, 1, 2]),
                   is_cancelled=rng.choice([0, 0, 1]), company=rng.choice(["C1", "C2", None])) for _ in range(400)]
    ledger = f"{tmp_path}/gl_entry"
    add(spark, ledger, *rows)
    snaps = BalanceSnapshots(spark, ledger, f"{tmp_path}/snapshots")
    snaps.refresh(month_ends(d("2023-11-01"), d("2024-02-29")))
    t = golden
    for p in (LedgerParams.of("2024-01-01", "2024-03-10"), LedgerParams.of("2023-12-15", "2024-01-20", company="C2")):
        same(t, snaps, p)
