"""Z-order: same rows, fewer row groups for a period and for a customer."""

from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tally.plans import reports as rep
from tally.plans.params import LedgerParams
from tally.sources.clustering import cell_bounds, write_clustered, z_key
from tally.sources.tpch_erp import erp_tables

from conftest import SF_CHECK

P = LedgerParams.of("1997-01-01", "1997-06-30", company="ASIA", customer="Party-3")
GROUP = 128 << 10


def row_groups(path, admits):
    """(admitted, all) row groups by the minimum and maximum in the footers."""
    found = []
    for f in sorted(Path(path).glob("*.parquet")):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            stats = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c).statistics
                     for c in range(meta.num_columns)}
            found.append(admits(lambda c, s=stats: (s[c].min, s[c].max)))
    return sum(found), len(found)


def test_fewer_row_groups_are_read(spark, tmp_path):
    t = erp_tables(spark, SF_CHECK)
    p = rep.with_codes(t, P)
    assert p.codes and all(c.startswith("CUST-") for c in p.codes)
    z, by_date = f"{tmp_path}/z", f"{tmp_path}/d"
    write_clustered(t.gl_entry, "gl_entry", z, GROUP, files=64)
    (t.gl_entry.repartitionByRange(64, "posting_date", "party").sortWithinPartitions("posting_date", "party")
     .write.option("parquet.block.size", GROUP).parquet(by_date))

    def of_customer(at):
        lo, hi = at("party")
        return any(lo <= c <= hi for c in p.codes)

    def of_period(at):
        lo, hi = at("posting_date")
        return lo <= P.to_date and hi >= P.from_date

    (z_one, z_all), (d_one, _) = (row_groups(x, of_customer) for x in (z, by_date))
    assert z_one < 0.5 * d_one and z_one < 0.5 * z_all, (z_one, d_one, z_all)
    z_period, _ = row_groups(z, of_period)
    assert z_period < 0.7 * z_all, (z_period, z_all)
    both, _ = row_groups(z, lambda at: of_customer(at) and of_period(at))
    assert both < z_one
    stored = t.replace(gl_entry=spark.read.parquet(z))
    got = rep.customer_financial_status(stored, p)
    assert got.collect() == rep.customer_financial_status(t, P).collect() != []
    length = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = rep.customer_financial_status(stored, p)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.maxMetadataStringLength", length)
    assert "In(party, [" in plan
    assert stored.gl_entry.exceptAll(t.gl_entry).count() == 0 == t.gl_entry.exceptAll(stored.gl_entry).count()


def test_keys_of_odd_columns(spark):
    df = spark.createDataFrame([(None, None), ("a", 1), ("b", None)], "a string, b int")
    bounds = cell_bounds(df, ["a", "b"], 4)
    keys = [r[0] for r in df.select(z_key(bounds, 4)).collect()]
    assert keys[0] == 0 and all(k >= 0 for k in keys)
    assert df.limit(0).select(z_key(cell_bounds(df.limit(0), ["a", "b"]))).count() == 0


def test_names_with_many_codes_stay_a_semi_join(spark, monkeypatch):
    monkeypatch.setattr(rep, "MOST_CODES", 1)
    t = erp_tables(spark, SF_CHECK)
    many = t.replace(customer_mapping=t.customer_mapping.select("customer_code", F.lit("one").alias("customer_name")))
    p = LedgerParams.of("1997-01-01", "1997-06-30", customer="one")
    assert rep.with_codes(many, p) == p
    none = LedgerParams.of("1997-01-01", "1997-06-30", customer="nobody")
    assert rep.with_codes(t, none).codes == () and rep.customer_financial_status(t, rep.with_codes(t, none)).count() == 0
