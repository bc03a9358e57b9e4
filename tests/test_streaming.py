"""The streaming ledger summary equals the batch report once all files are in."""

import pytest

from tally.plans import reports as rep
from tally.plans.params import LedgerParams
from tally.sources.tpch_erp import erp_tables
from tally.streaming import read_entries, running_balances, start

from conftest import SF_SMALL

MONEY = ("opening_balance", "invoiced_amount", "return_amount", "paid_amount", "closing_balance")


def test_stream_matches_batch(spark, tmp_path):
    t = erp_tables(spark, SF_SMALL)
    p = LedgerParams.of("1997-01-01", "1998-12-31", company="ASIA")
    src = str(tmp_path / "gl")
    # land the ledger as two batches of files
    gl = t.gl_entry
    gl.where("posting_date < date'1996-01-01'").write.parquet(src + "/part=1")
    gl.where("posting_date >= date'1996-01-01'").write.parquet(src + "/part=2")
    stream = read_entries(spark, src + "/*", max_files_per_trigger=1)
    q = start(running_balances(stream, t, p), str(tmp_path / "ckpt"), sink="memory", query_name="bal_test")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.sql("SELECT * FROM bal_test").toPandas()
    # update mode appends a row per change; keep the latest per name
    got = got.drop_duplicates("customer_name", keep="last")
    got = got[~got.is_suppressed].set_index("customer_name")
    want = rep.customer_financial_status(t, p).toPandas().set_index("customer_name")
    assert sorted(got.index, key=str) == sorted(want.index, key=str)
    for c in MONEY:
        for name in want.index:
            assert got.loc[name, c] == pytest.approx(want.loc[name, c]), (name, c)
