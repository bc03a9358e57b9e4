"""Table loaders: parquet folders and the catalog give the same reports as
the derived frames; schemas are enforced on load; tables load lazily."""

import pytest

from tally.plans import reports as rep
from tally.plans.params import LedgerParams, OrderParams
from tally.sources.tables import TABLES, ErpTables, from_parquet
from tally.sources.tpch_erp import erp_tables

from conftest import SF_SMALL

P = LedgerParams.of("1997-01-01", "1998-12-31", company="ASIA")
O = OrderParams.of("1997-01-01", "1998-12-31", as_of="2002-01-01")


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("erp")
    t = erp_tables(spark, SF_SMALL)
    for name in TABLES:
        getattr(t, name).write.parquet(str(root / name))
    return t, str(root)


def test_parquet_folders_give_the_same_reports(spark, written):
    derived, root = written
    loaded = from_parquet(spark, root)
    # both reports have a total order, so the row lists compare as they are
    assert rep.customer_financial_status(loaded, P).collect() == (
        rep.customer_financial_status(derived, P).collect())
    assert rep.item_sales_for_period(loaded, O).collect() == (
        rep.item_sales_for_period(derived, O).collect())


def test_missing_adjustments_folder_reads_empty(spark, written, tmp_path):
    _, root = written
    import shutil
    partial = tmp_path / "erp"
    for name in TABLES:
        if name != "party_adjustment":
            shutil.copytree(f"{root}/{name}", partial / name)
    t = from_parquet(spark, str(partial))
    assert t.party_adjustment.count() == 0


def test_missing_column_is_rejected(spark):
    bad = spark.createDataFrame([("x",)], "customer_code string")
    t = ErpTables({n: bad for n in TABLES if n != "party_adjustment"})
    with pytest.raises(ValueError, match="missing columns"):
        t.customer_mapping  # noqa: B018


def test_null_debit_fails_the_job(spark):
    from decimal import Decimal

    from tally.sources.schemas import SCHEMAS, conform
    import datetime as dt
    rows = [(dt.date(2024, 1, 1), "Customer", "A", "x", "V", None, None, None, Decimal(1),
             "No", 1, 0, "C", None)]
    schema = SCHEMAS["gl_entry"]
    from pyspark.sql.types import StructField, StructType
    loose = StructType([StructField(f.name, f.dataType, True) for f in schema.fields])
    df = conform(spark.createDataFrame(rows, loose), "gl_entry")
    with pytest.raises(Exception, match="gl_entry.debit is NULL"):
        df.collect()


def test_tables_load_lazily(spark):
    calls = []

    def boom():
        calls.append(1)
        raise AssertionError("should not be read")

    t = erp_tables(spark, SF_SMALL).replace(gl_entry=boom)
    rep.item_sales_for_period(t, O).count()
    assert calls == []


def test_date_partitioned_layout_prunes_directories(spark, tmp_path):
    import contextlib
    import io

    from fixtures import golden_tables
    from tally.sources.layout import write_table
    golden = golden_tables(spark)
    path = str(tmp_path / "gl_entry")
    write_table(golden.gl_entry, "gl_entry", path)
    loaded = golden.replace(gl_entry=spark.read.parquet(path))
    p = LedgerParams.of("2024-02-01", "2024-02-29", company="C1")
    r3 = rep.customer_receipts(loaded, p)
    assert r3.collect() == rep.customer_receipts(golden, p).collect()
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        r3.explain(mode="formatted")
    scans = [l for l in buf.getvalue().splitlines() if l.startswith("PartitionFilters")]
    assert any("posting_date" in l and "2024-02-01" in l for l in scans), scans


def test_only_an_absent_adjustment_table_reads_empty(spark, tmp_path):
    (tmp_path / "party_adjustment").mkdir()
    (tmp_path / "party_adjustment" / "part-0.parquet").write_bytes(b"not a parquet file")
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        from_parquet(spark, str(tmp_path)).party_adjustment.count()


@pytest.mark.parametrize("text", ["2024-01-015", "2024-01-01 garbage", "2024-1-1"])
def test_dates_with_other_text_are_refused(text):
    from tally.functions.dates import parse_date
    with pytest.raises(ValueError):
        parse_date(text)


def test_dates_with_a_time_of_day():
    import datetime as dt

    from tally.functions.dates import parse_date
    assert parse_date("2024-01-01 10:20:30.5") == parse_date("2024-01-01T10:20") == dt.date(2024, 1, 1)
