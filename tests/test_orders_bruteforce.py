"""Random order data against a brute-force expansion of the reference's
query: every line joined to all its mapping, submitted-invoice and grade
rows, then grouped by the line (SUM of invoice qty, MIN of name / grade)."""

import datetime as dt
import random

import pytest

from tally.plans import reports as rep
from tally.plans.params import OrderParams
from tally.sources.schemas import SCHEMAS
from tally.sources.tables import from_frames

GRADE = "الدرجة"
D0 = dt.date(2024, 5, 1)


def random_orders(seed):
    rnd = random.Random(seed)
    codes = [f"C{i}" for i in range(8)]
    mapping = [(rnd.choice(codes), rnd.choice(["Ann", "Bob", "Cy"])) for _ in range(10)]
    items = [f"I{i}" for i in range(6)]
    iva = [(rnd.choice(items), rnd.choice([GRADE, GRADE, "size"]), rnd.choice("ABC")) for _ in range(9)]
    statuses = ["To Bill", "Completed", "On Hold", "Closed", "Stopped", None]
    so = [(f"SO{i}", rnd.choice(codes + [None]), D0 + dt.timedelta(days=rnd.randint(-10, 40)),
           rnd.choice(statuses), rnd.choice([1, 1, 1, 0, 2]), "K") for i in range(25)]
    soi, sii = [], []
    for i in range(60):
        name = f"L{i:03d}"
        soi.append((name, f"SO{rnd.randrange(25)}", rnd.choice(items), D0, float(rnd.randint(1, 9)),
                    float(rnd.randint(0, 3)), 10.0))
        for _ in range(rnd.randint(0, 3)):
            sii.append((name, float(rnd.randint(1, 5)), rnd.choice([1, 1, 2])))
    return so, soi, sii, mapping, iva


def brute(so, soi, sii, mapping, iva, f, t, grade=True):
    orders = {o[0]: o for o in so if o[3] not in ("Stopped", "Closed", "On Hold") and o[3] is not None
              and o[4] == 1 and f <= o[2] <= t}
    out = {}
    for name, parent, item, *_ in soi:
        if parent not in orders:
            continue
        o = orders[parent]
        names = [n for c, n in mapping if c == o[1]] or [None]
        invs = [q for d, q, ds in sii if d == name and ds == 1] or [None]
        grades = ([v for p, a, v in iva if p == item and a == GRADE] or [None]) if grade else [None]
        qtys = [q for _ in names for q in invs for _ in grades if q is not None]
        nn = [n for n in names if n is not None]
        gg = [g for g in grades if g is not None]
        out[name] = (min(nn) if nn else None, sum(qtys) if qtys else 0.0, min(gg) if gg else None)
    return out


def tables(spark, so, soi, sii, mapping, iva):
    frames = {
        "sales_order": spark.createDataFrame(so, SCHEMAS["sales_order"]),
        "sales_order_item": spark.createDataFrame(soi, SCHEMAS["sales_order_item"]),
        "sales_invoice_item": spark.createDataFrame(sii, SCHEMAS["sales_invoice_item"]),
        "customer_mapping": spark.createDataFrame(mapping, SCHEMAS["customer_mapping"]),
        "item_variant_attribute": spark.createDataFrame(iva, SCHEMAS["item_variant_attribute"]),
    }
    for name in ("gl_entry", "sales_invoice", "delivery_note", "delivery_note_item", "company"):
        frames[name] = spark.createDataFrame([], SCHEMAS[name])
    return from_frames(spark, **frames)


@pytest.mark.parametrize("seed", [11, 12, 13])
def test_item_sales_matches_expansion(spark, seed):
    data = random_orders(seed)
    t = tables(spark, *data)
    f, to = D0, D0 + dt.timedelta(days=30)
    want = brute(*data, f, to)
    got = rep.item_sales_for_period(t, OrderParams.of(f, to, as_of=D0)).collect()
    assert {r.soi_name: (r.customer_name, r.billed_qty, r.grade) for r in got} == want
    keys = [(r.date, r.item_code, r.soi_name) for r in got]
    assert keys == sorted(keys)
