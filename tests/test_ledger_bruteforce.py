"""Random ledgers against a brute-force fold of the rules:
per entry, in date order, into a dict keyed by customer name."""

import datetime as dt
import random
from decimal import Decimal

import pytest

from tally.plans import reports as rep
from tally.plans.params import LedgerParams
from tally.sources.schemas import SCHEMAS
from tally.sources.tables import from_frames

FROM, TO = dt.date(2024, 3, 1), dt.date(2024, 3, 31)


def random_tables(seed):
    rnd = random.Random(seed)
    codes = [f"C{i}" for i in range(12)]
    names = ["N0", "N1", "N2", "N3", "N4"]
    mapping = [(c, rnd.choice(names)) for c in codes[:9]]
    mapping += [(rnd.choice(codes[:9]), rnd.choice(names)) for _ in range(3)]   # fan-out
    invoices = [(f"R{i}", rnd.choice([1, 1, 2]), rnd.choice([0, 1, 1]),
                 FROM + dt.timedelta(days=rnd.randint(-20, 40))) for i in range(10)]
    gl = []
    for _ in range(rnd.randint(30, 80)):
        amount = Decimal(rnd.randint(1, 500)) / 4
        debit, credit = (amount, Decimal(0)) if rnd.random() < 0.5 else (Decimal(0), amount)
        gl.append((
            FROM + dt.timedelta(days=rnd.randint(-40, 45)),
            rnd.choice(["Customer"] * 5 + ["Supplier"]),
            rnd.choice(codes + ["", None]),
            "x",
            rnd.choice([f"R{i}" for i in range(12)] + ["V1", "V2", None]),
            None, None, debit, credit,
            rnd.choice(["No", "No", "No", "Yes", None]),
            rnd.choice([0, 1, 1, 1, 2]),
            rnd.choice([0, 0, 0, 1]),
            rnd.choice(["K1", "K1", "K2"]),
            rnd.choice(["B1", "B2", None]),
        ))
    return gl, mapping, invoices


def fold(gl, mapping, invoices, period_only, finance_book=None, company="K1"):
    returns = {n for n, ds, ir, d in invoices if ds == 1 and ir == 1 and d >= FROM}
    names = {}
    for code, name in mapping:
        names.setdefault(code, []).append(name)
    out = {}
    rows = [r for r in gl if r[10] < 2 and r[11] == 0 and r[1] == "Customer" and (r[2] or "") != ""
            and (FROM <= r[0] <= TO if period_only else r[0] <= TO) and r[12] == company
            and (finance_book is None or (r[13] or "") in (finance_book, ""))]
    for r in rows:
        for name in names.get(r[2], [None]):
            acc = out.setdefault(name, dict(o=Decimal(0), i=Decimal(0), r=Decimal(0), p=Decimal(0),
                                            c=Decimal(0), first=r[0]))
            acc["first"] = min(acc["first"], r[0])
            amt = r[7] - r[8]
            acc["c"] += amt
            if r[0] < FROM or r[9] == "Yes":
                acc["o"] += amt
            elif amt > 0:
                acc["i"] += amt
            elif r[4] in returns:
                acc["r"] -= amt
            else:
                acc["p"] -= amt
    return {k: v for k, v in out.items() if v["o"] or v["i"] or v["p"] or v["r"]}


def build(spark, gl, mapping, invoices):
    frames = dict(
        gl_entry=spark.createDataFrame(gl, SCHEMAS["gl_entry"]),
        customer_mapping=spark.createDataFrame(mapping, SCHEMAS["customer_mapping"]),
        sales_invoice=spark.createDataFrame(invoices, SCHEMAS["sales_invoice"]),
        company=spark.createDataFrame([("K1", "EGP")], SCHEMAS["company"]),
    )
    for name in ("sales_order", "sales_order_item", "sales_invoice_item", "item_variant_attribute",
                 "delivery_note", "delivery_note_item"):
        frames[name] = spark.createDataFrame([], SCHEMAS[name])
    return from_frames(spark, **frames)


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_financial_status_matches_fold(spark, seed):
    gl, mapping, invoices = random_tables(seed)
    t = build(spark, gl, mapping, invoices)
    want = fold(gl, mapping, invoices, period_only=False)
    got = rep.customer_financial_status(t, LedgerParams.of(FROM, TO, company="K1")).collect()
    assert [r.customer_name for r in got] == sorted(want, key=lambda k: (want[k]["first"], k is not None, k or ""))
    for r in got:
        w = want[r.customer_name]
        assert (r.opening_balance, r.invoiced_amount, r.return_amount, r.paid_amount, r.closing_balance) == (
            float(w["o"]), float(w["i"]), float(w["r"]), float(w["p"]), float(w["c"]))


@pytest.mark.parametrize("seed", [5, 6])
def test_receipts_match_fold(spark, seed):
    gl, mapping, invoices = random_tables(seed)
    t = build(spark, gl, mapping, invoices)
    want = fold(gl, mapping, invoices, period_only=True, finance_book="B1")
    got = rep.customer_receipts(t, LedgerParams.of(FROM, TO, company="K1", finance_book="B1")).collect()
    assert {r.customer_name for r in got} == set(want)
    for r in got:
        w = want[r.customer_name]
        assert r.posting_date == w["first"].isoformat()
        assert (r.paid_amount, r.closing_balance) == (float(w["p"]), float(w["c"]))
