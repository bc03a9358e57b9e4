"""A hot party (a third of all entries), a heavy NULL group and a hot
order / item, with AQE made to split skewed partitions on tiny data:
results must not change."""

import contextlib
import datetime as dt
import random
from decimal import Decimal

import pytest

from tally.plans import reports as rep
from tally.plans.params import LedgerParams, OrderParams
from tally.sources.schemas import SCHEMAS
from tally.sources.tables import from_frames

from test_ledger_bruteforce import FROM, TO, fold

SKEW_CONF = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
}


@contextlib.contextmanager
def conf(spark, values):
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def skewed_ledger(n=3000, seed=7):
    rnd = random.Random(seed)
    codes = [f"C{i}" for i in range(40)]
    mapping = [(c, f"N{i % 7}") for i, c in enumerate(codes[:25])] + [("HOT", "Hot")]
    invoices = [(f"R{i}", 1, 1, FROM + dt.timedelta(days=rnd.randint(-5, 20))) for i in range(30)]
    gl = []
    for i in range(n):
        party = "HOT" if i % 3 == 0 else rnd.choice(codes)       # a third on one party
        amount = Decimal(rnd.randint(1, 900)) / 4
        debit, credit = (amount, Decimal(0)) if rnd.random() < 0.5 else (Decimal(0), amount)
        gl.append((FROM + dt.timedelta(days=rnd.randint(-60, 30)), "Customer", party, "x",
                   rnd.choice([f"R{j}" for j in range(40)] + ["HOTV"] * 20), None, None,
                   debit, credit, rnd.choice(["No"] * 9 + ["Yes"]), 1, 0, "K1", None))
    return gl, mapping, invoices


def tables(spark, gl, mapping, invoices, **extra):
    frames = dict(
        gl_entry=spark.createDataFrame(gl, SCHEMAS["gl_entry"]),
        customer_mapping=spark.createDataFrame(mapping, SCHEMAS["customer_mapping"]),
        sales_invoice=spark.createDataFrame(invoices, SCHEMAS["sales_invoice"]),
        company=spark.createDataFrame([("K1", "EGP")], SCHEMAS["company"]),
    )
    for name in ("sales_order", "sales_order_item", "sales_invoice_item", "item_variant_attribute",
                 "delivery_note", "delivery_note_item"):
        frames[name] = extra.get(name) or spark.createDataFrame([], SCHEMAS[name])
    return from_frames(spark, **frames)


def test_hot_party_ledger_under_skew_splitting(spark):
    gl, mapping, invoices = skewed_ledger()
    t = tables(spark, gl.copy(), mapping, invoices)
    want = fold(gl, mapping, invoices, period_only=False)
    with conf(spark, SKEW_CONF):
        got = rep.customer_financial_status(t, LedgerParams.of(FROM, TO, company="K1")).collect()
    assert {r.customer_name for r in got} == set(want)
    for r in got:
        w = want[r.customer_name]
        assert (r.opening_balance, r.invoiced_amount, r.return_amount, r.paid_amount,
                r.closing_balance) == (float(w["o"]), float(w["i"]), float(w["r"]), float(w["p"]),
                                       float(w["c"]))


def test_hot_order_and_item_under_skew_splitting(spark):
    d = dt.date(2024, 3, 5)
    so = [("SO-H", "HOT", d, "To Bill", 1, "K1")] + [
        (f"SO-{i}", f"C{i % 40}", d, "To Bill", 1, "K1") for i in range(200)]
    soi = [(f"L-H-{j:04d}", "SO-H", "ITEM-H", d, 1.0, 0.0, 1.0) for j in range(400)]
    soi += [(f"L-{i}", f"SO-{i}", "ITEM-H" if i % 2 else f"ITEM-{i}", d, 2.0, 1.0, 2.0) for i in range(200)]
    sii = [(f"L-H-{j % 400:04d}", 1.0, 1) for j in range(1200)] + [(f"L-{i}", 2.0, 1) for i in range(200)]
    iva = [("ITEM-H", "الدرجة", "A")]
    gl, mapping, invoices = skewed_ledger(10)
    t = tables(spark, gl, mapping, invoices,
               sales_order=spark.createDataFrame(so, SCHEMAS["sales_order"]),
               sales_order_item=spark.createDataFrame(soi, SCHEMAS["sales_order_item"]),
               sales_invoice_item=spark.createDataFrame(sii, SCHEMAS["sales_invoice_item"]),
               item_variant_attribute=spark.createDataFrame(iva, SCHEMAS["item_variant_attribute"]))
    p = OrderParams.of("2024-03-01", "2024-03-31", as_of="2024-04-01")
    with conf(spark, SKEW_CONF):
        rows = rep.item_sales_for_period(t, p, with_total=True).collect()
    detail = [r for r in rows if r.is_total == 0]
    assert len(detail) == 600
    hot = [r for r in detail if r.sales_order == "SO-H"]
    assert {(r.customer_name, r.billed_qty, r.grade) for r in hot} == {("Hot", 3.0, "A")}
    assert rows[-1].qty == pytest.approx(400 * 1.0 + 200 * 2.0)
    # order: date, item_code, line name
    keys = [(r.date, r.item_code, r.soi_name) for r in detail]
    assert keys == sorted(keys)


def test_lookup_equals_plain_join_and_splits_hot_key(spark):
    from pyspark.sql import functions as F

    from tally.operators.joins import lookup_join
    left = spark.range(0, 6000, numPartitions=4).select(
        F.when(F.col("id") % 3 == 0, "HOT").when(F.col("id") % 7 == 1, None).otherwise(
            F.concat(F.lit("K"), (F.col("id") % 50).cast("string"))).alias("k"),
        F.col("id").cast("string").alias("line"))
    # as in the reports, the lookup side is aggregated by key
    right = spark.createDataFrame([(f"K{i}", f"v{i}") for i in range(0, 50, 2)] + [("HOT", "h"), (None, "n")],
                                  "rk string, v string").groupBy("rk").agg(F.min("v").alias("v"))
    with conf(spark, {**SKEW_CONF, "spark.sql.shuffle.partitions": "16"}):
        plain = left.join(right, F.col("k") == F.col("rk"), "left")
        split = lookup_join(left, right, "k", "rk", "left")
        assert sorted(plain.collect(), key=str) == sorted(split.collect(), key=str)
        hot_parts = (split.where("v = 'h'").select(F.spark_partition_id().alias("p"))
                     .distinct().count())
    assert hot_parts > 1


def test_classify_with_hot_and_null_vouchers(spark):
    from tally.operators.ledger import classify
    gl, mapping, invoices = skewed_ledger(n=2000, seed=9)
    # a third of the entries on one voucher, a tenth with no voucher
    gl = [(*r[:4], "HOTV" if i % 3 == 0 else (None if i % 10 == 1 else r[4]), *r[5:])
          for i, r in enumerate(gl)]
    invoices = invoices + [("HOTV", 1, 1, FROM)]
    t = tables(spark, gl, mapping, invoices)
    returns = {n for n, ds, ir, d in invoices if ds == 1 and ir == 1 and d >= FROM}
    with conf(spark, SKEW_CONF):
        got = classify(t.gl_entry, t.sales_invoice.where("is_return = 1 and posting_date >= date'2024-03-01'"),
                       FROM, "Customer").select("voucher_no", "posting_date", "debit", "credit",
                                                "is_opening", "bucket").collect()
    want = []
    for r in gl:
        amt = r[7] - r[8]
        if r[0] < FROM or r[9] == "Yes":
            b = "opening"
        elif amt > 0:
            b = "invoiced"
        elif r[4] in returns:
            b = "return"
        else:
            b = "paid"
        want.append((r[4], r[0], float(r[7]), float(r[8]), r[9], b))
    norm = sorted(((g.voucher_no or ""), g.posting_date, float(g.debit), float(g.credit), g.is_opening,
                   g.bucket) for g in got)
    assert norm == sorted(((w[0] or ""), *w[1:]) for w in want)
