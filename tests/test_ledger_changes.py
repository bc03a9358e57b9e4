"""The change stream equals the batch report, also after a late return."""

import pytest

from tally.plans import reports as rep
from tally.plans.params import LedgerParams
from tally.sources.schemas import SCHEMAS
from tally.streaming.ledger_changes import ledger_changes, read_invoices, start_changes, status_from_changes
from tally.streaming.ledger_stream import read_entries

from fixtures import d, gl_row, golden_tables

P = LedgerParams.of("2024-02-01", "2024-02-29", company="C1")


@pytest.fixture
def flow(spark, tmp_path):
    """land(entries=..., invoices=...) files them, runs the stream once and gives R1 by both ways."""
    golden = golden_tables(spark)
    gl, inv, out = (f"{tmp_path}/{x}" for x in ("gl", "inv", "changes"))
    landed = {"gl_entry": [], "sales_invoice": []}
    for path, name in ((gl, "gl_entry"), (inv, "sales_invoice")):
        spark.createDataFrame([], SCHEMAS[name]).write.parquet(path)

    def land(entries=(), invoices=(), p=P):
        for path, name, rows in ((gl, "gl_entry", entries), (inv, "sales_invoice", invoices)):
            landed[name] += rows
            if rows:
                spark.createDataFrame(list(rows), SCHEMAS[name]).coalesce(1).write.mode("append").parquet(path)
        changes = ledger_changes(read_entries(spark, gl), read_invoices(spark, inv), P)
        start_changes(changes, out, f"{tmp_path}/ckpt", available_now=True).awaitTermination()
        t = golden.replace(**{k: spark.createDataFrame(v, SCHEMAS[k]) for k, v in landed.items()})
        got = status_from_changes(spark.read.parquet(out), t, p).collect()
        want = rep.customer_financial_status(t, p).select(*got[0].__fields__).collect() if got else []
        return got, want

    return land


def test_late_return_is_rebucketed(flow):
    first, want = flow([gl_row("2024-01-10", "Customer", "A1", "SINV-1", 100),
                        gl_row("2024-02-10", "Customer", "A1", "PAY-1", 0, 30),
                        gl_row("2024-02-12", "Customer", "A2", "SRET-1", 0, 20),
                        gl_row("2024-02-13", "Customer", "B1", "SRET-1", 0, 7)])
    assert first == want and {r.customer_name: r.paid_amount for r in first} == {"Alpha": 50.0, "Beta": 7.0}
    late, want = flow(invoices=[("SRET-1", 1, 1, d("2024-02-12")), ("SRET-0", 1, 1, d("2024-01-15")), ("PAY-1", 1, 0, d("2024-02-01"))])
    assert late == want and {r.customer_name: (r.paid_amount, r.return_amount) for r in late} == {
        "Alpha": (30.0, 20.0), "Beta": (0.0, 7.0)}
    more, want = flow([gl_row("2024-02-14", "Customer", "A1", "SRET-1", 0, 5), gl_row("2024-02-15", "Customer", "D1", "SRET-0", 0, 4),
                       gl_row("2024-02-15", "Customer", "A1", "JV-1", 7, is_opening="Yes")])
    assert more == want and more != late


def test_entry_and_return_in_one_batch_and_customer_filter(flow):
    got, want = flow([gl_row("2024-02-12", "Customer", "A2", "SRET-1", 0, 20), gl_row("2024-02-03", "Customer", "B1", "SINV-4", 40),
                      gl_row("2024-02-20", "Customer", "A1", "SINV-10", 13, docstatus=2), gl_row("2024-03-01", "Customer", "A1", "SINV-9", 9),
                      gl_row("2024-02-21", "Customer", "A1", "SINV-11", 17, company="C2")],
                     [("SRET-1", 1, 1, d("2024-02-12"))])
    assert got == want and len(got) == 2
    only = LedgerParams.of("2024-02-01", "2024-02-29", company="C1", customer="Alpha")
    got, want = flow(p=only)
    assert got == want and [r.customer_name for r in got] == ["Alpha"]
