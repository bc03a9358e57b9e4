"""Order tables stored by buckets: the item reports' large joins move no row."""

import uuid

import pytest
from pyspark.sql import functions as F

from tally.plans import reports as rep
from tally.plans.params import OrderParams
from tally.sources import buckets

from fixtures import golden_tables

O = OrderParams.of("2024-02-01", "2024-02-29", as_of="2024-03-01")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    name = f"b_{uuid.uuid4().hex}"
    kept = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition", "true")
    buckets.write_buckets(golden_tables(spark), name, 4, f"file://{tmp_path_factory.mktemp('b')}")
    yield name
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", kept)
    spark.sql(f"DROP DATABASE {name} CASCADE")


def test_reports_are_the_same(spark, stored):
    t, g = buckets.from_buckets(spark, stored), golden_tables(spark)
    for f, p in ((rep.item_sales_for_period, O), (rep.item_sales_for_customer, O),
                 (rep.item_sales_for_period, OrderParams.of(item="ITEM-X", as_of="2024-03-01")),
                 (rep.item_sales_for_customer, OrderParams.of(customer="Alpha", as_of="2024-03-01"))):
        assert f(t, p).collect() == f(g, p).collect() != []
        assert f(t, p, with_total=True).collect() == f(g, p, with_total=True).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(rep.so_elapsed_time(t).collect(), key=key) == sorted(rep.so_elapsed_time(g).collect(), key=key)


def nodes(plan):
    """(depth, line) of the physical plan, without AQE's own."""
    return [(len(x) - len(x.lstrip(" :+-")), x.lstrip(" :+-")) for x in plan.splitlines() if x.strip()]


def test_no_exchange_below_the_line_joins(spark, stored):
    t = buckets.from_buckets(spark, stored)
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = rep.item_sales_for_period(t, O)._jdf.queryExecution().sparkPlan().toString()
        planned = rep.item_sales_for_period(t, O)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    assert "SortMergeJoin" in text
    rows = nodes(planned)
    for k, (depth, line) in enumerate(rows):
        if line.startswith("SortMergeJoin") and ("_so_detail" in line or "_parent" in line):
            below = [x for x in rows[k + 1:next((j for j in range(k + 1, len(rows)) if rows[j][0] <= depth), len(rows))]]
            assert below and not any(x.startswith("Exchange") for _, x in below), line
    assert sum("SortMergeJoin [sales_order" in x for _, x in rows) >= 1


def test_invoice_items_without_a_line_spread(spark):
    g = golden_tables(spark)
    lost = spark.range(2000).select(F.lit(None).cast("string").alias("so_detail"), F.lit(1.0).alias("qty"), F.lit(1).alias("docstatus"))
    made = buckets.with_order_of_line(lost.unionByName(g.sales_invoice_item), g.sales_order_item)
    assert made.count() == 2000 + g.sales_invoice_item.count()
    assert made.groupBy("order_of_line").count().agg(F.max("count")).first()[0] == 3
    assert made.where("so_detail is not null and order_of_line not like 'SO-%'").count() == 0


def test_an_order_larger_than_its_bucket_is_refused(spark):
    lines = spark.range(300_000).select(F.when(F.col("id") < 150_000, "SO-1").otherwise(F.concat(F.lit("SO-"), "id")).alias("parent"))
    with pytest.raises(ValueError, match="150000 of 300000"):
        buckets._check_even(lines, "sales_order_item", "parent", 100)
    buckets._check_even(lines, "sales_order_item", "parent", 3)


def test_every_table_is_made_once(spark, tmp_path):
    g = golden_tables(spark)
    seen = {name: spark.sparkContext.accumulator(0) for name in buckets.BUCKET_BY}

    def counted(name):
        df, tally = getattr(g, name), seen[name]

        def look(_):
            tally.add(1)
            return True
        return df.where(F.udf(look, "boolean").asNondeterministic()(F.col(df.columns[0])))

    name = f"b_{uuid.uuid4().hex}"
    buckets.write_buckets(g.replace(**{x: counted(x) for x in seen}), name, 4, f"file://{tmp_path}")
    try:
        rows = {x: getattr(g, x).count() for x in seen}
        assert {x: a.value for x, a in seen.items()} == rows
        assert {x: spark.table(f"{name}.{x}").count() for x in seen} == rows
    finally:
        spark.sql(f"DROP DATABASE {name} CASCADE")


def test_a_refused_table_is_not_kept(spark, tmp_path):
    g = golden_tables(spark)
    one = g.sales_order_item.limit(1).crossJoin(spark.range(120_001)).withColumn("name", F.concat("name", F.col("id"))).drop("id")
    name = f"b_{uuid.uuid4().hex}"
    try:
        with pytest.raises(ValueError, match="120001 of 120001"):
            buckets.write_buckets(g.replace(sales_order_item=one), name, 4, f"file://{tmp_path}")
        assert not spark.catalog.tableExists(f"{name}.sales_order_item")
    finally:
        spark.sql(f"DROP DATABASE {name} CASCADE")
