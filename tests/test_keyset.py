"""The bounded key bitmap: keeps every match, cuts most others."""

import pytest
from pyspark.sql import functions as F

from tally.operators import keyset
from tally.sources.tpch_erp import erp_tables

from conftest import SF_SMALL


def keys(spark, n, step=1):
    return spark.range(0, n * step, step).select(F.concat(F.lit("K-"), F.col("id")).alias("k"))


def test_no_match_is_lost_and_others_are_cut(spark):
    rows = keys(spark, 20_000).withColumn("_at", F.lit("clash"))
    some = keys(spark, 400, 50)
    left = keyset.within(rows, "k", some, "k")
    assert left.columns == rows.columns
    got = {r.k for r in left.collect()}
    assert {r.k for r in some.collect()} <= got and len(got) < 420
    tight = keyset.within(rows, "k", some, "k", bits=keyset.PIECE_BITS)
    assert {r.k for r in some.collect()} <= {r.k for r in tight.collect()}


def test_bitmap_size_is_bounded(spark):
    bits = 4 * keyset.PIECE_BITS
    found = keyset.key_bitmap(keys(spark, 50_000), "k", bits).collect()
    assert len(found) == 4 and all(len(r._bitmap) == 4096 for r in found)
    assert keyset.within(keys(spark, 3000), "k", keys(spark, 500_000), "k", bits).count() == 3000
    with pytest.raises(ValueError):
        keyset.key_bitmap(keys(spark, 1), "k", 100)


def test_nulls_and_nothing(spark):
    rows = spark.createDataFrame([("a",), (None,), ("b",)], "k string")
    assert [r.k for r in keyset.within(rows, "k", spark.createDataFrame([(None,), ("a",)], "k string"), "k").collect()] == ["a"]
    assert keyset.within(rows, "k", rows.limit(0), "k").count() == 0
    flags = keyset.maybe_in(rows, "k", rows.where("k = 'b'"), "k", "hit").collect()
    assert sorted(((r.k or ""), r.hit) for r in flags) == [("", False), ("a", False), ("b", True)]


def test_collated_keys_are_not_cut(spark):
    rows = spark.createDataFrame([("a",), ("B",)], "k string").select(F.collate("k", "UNICODE_CI").alias("k"))
    assert keyset.within(rows, "k", rows.where("k = 'b'"), "k").count() == 2


def test_size_is_that_of_the_files(spark):
    t = erp_tables(spark, SF_SMALL)
    for df in (t.gl_entry, t.sales_invoice_item, t.sales_invoice):
        assert not keyset.worth_cutting(df)
    spark.conf.set("tally.keyset.minBytes", "10000")
    try:
        assert keyset.worth_cutting(t.gl_entry) and not keyset.worth_cutting(t.company)
    finally:
        spark.conf.unset("tally.keyset.minBytes")
    spark.conf.set("tally.keyset.minBytes", "100000000")
    try:
        assert not keyset.worth_cutting(t.gl_entry)
    finally:
        spark.conf.unset("tally.keyset.minBytes")
