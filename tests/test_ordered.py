"""The ordered sink keeps a report's order over several files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tally.sources.ordered import read_ordered, write_ordered

def order():
    return [F.col(c).asc() for c in ("date", "item", "line")]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rows = [(dt.date(2024, 1, 1) if k % 3 else None if k % 7 == 0 else dt.date(2024, 1, k % 28 + 1), f"I{k % 5}", f"L{k:05d}")
            for k in range(3000)]
    path = f"{tmp_path_factory.mktemp('o')}/r"
    write_ordered(spark.createDataFrame(rows, "date date, item string, line string").repartition(5), path, order(), files=6)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or dt.date.min, r[1], r[2]))
    return path, want


def test_order_is_kept_over_files_with_a_hot_date(spark, stored):
    path, want = stored
    got = read_ordered(spark, path).orderBy("position").collect()
    assert [tuple(r)[:3] for r in got] == want and [r.position for r in got] == list(range(1, 3001))
    hot = spark.read.parquet(f"{path}/rows").where("date = date'2024-01-01'")
    assert hot.select("_file").distinct().count() >= 3  # two thirds of the rows have one date


def test_a_page_opens_its_files_only(spark, stored):
    path, want = stored
    for first, count in ((1, 10), (990, 40), (2995, 100), (3001, 5)):
        page = read_ordered(spark, path, first, count)
        assert [tuple(r)[:3] for r in page.collect()] == want[first - 1:first - 1 + count]
    text = read_ordered(spark, path, 1, 10)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_file" in text and "(_file#" in text


def test_nothing_and_taken_names(spark, tmp_path):
    empty = spark.createDataFrame([], "date date, item string, line string")
    write_ordered(empty, f"{tmp_path}/e", order(), files=2)
    assert read_ordered(spark, f"{tmp_path}/e").count() == 0
    with pytest.raises(ValueError):
        write_ordered(empty.withColumn("position", F.lit(1)), f"{tmp_path}/x", order())
