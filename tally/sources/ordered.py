"""Ordered sink and paged source for reports.

A report's rows come back to the reference's caller as one ordered list.  A
DataFrame written to files keeps its rows but promises no order to a reader.
:func:`write_ordered` stores the order with the rows:

* rows are range-partitioned and sorted by the report's own order; the order
  ends in a unique column, so a hot date is split over as many files as it needs;
* every file has a number and every row its place in the file;
* a manifest (one row a file: number, rows, position of the first) turns
  both into a global position, without any sort or count of rows at reading.

:func:`read_ordered` gives the rows with their ``position`` (from 1);
with ``first``/``count`` only the files that hold that page are opened.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FILE, PLACE, POSITION = "_file", "_place", "position"


def write_ordered(df: DataFrame, path: str, order: Sequence[Column], files: int | None = None) -> None:
    """Store ``df`` in ``order`` under ``path`` (``rows``, ``schema``, ``manifest``)."""
    if {FILE, PLACE, POSITION} & set(df.columns):
        raise ValueError(f"columns {FILE}, {PLACE} and {POSITION} are taken")
    dealt = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
    numbered = dealt.sortWithinPartitions(*order).withColumns({
        FILE: F.spark_partition_id(),
        PLACE: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1})
    numbered.write.partitionBy(FILE).parquet(f"{path}/rows")
    numbered.limit(0).coalesce(1).write.parquet(f"{path}/schema")  # for a report without rows
    spark = df.sparkSession
    rows = spark.read.schema(numbered.schema).parquet(f"{path}/rows")
    sizes = rows.groupBy(FILE).agg(F.max(PLACE).alias("rows"))
    before = Window.orderBy(FILE).rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    manifest = sizes.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    manifest.coalesce(1).write.parquet(f"{path}/manifest")


def read_ordered(spark: SparkSession, path: str, first: int | None = None, count: int | None = None) -> DataFrame:
    """The stored rows with their ``position``.  With ``first`` and ``count``
    that page, in order; the whole table comes unsorted (``orderBy(position)`` sorts it)."""
    manifest = spark.read.parquet(f"{path}/manifest")
    rows = spark.read.schema(spark.read.parquet(f"{path}/schema").schema).parquet(f"{path}/rows")
    if first is not None:
        last = first + (count or 0)
        manifest = manifest.where((F.col("before") < last - 1) & (F.col("before") + F.col("rows") >= first))
        holding = [r[FILE] for r in manifest.select(FILE).collect()]  # the files of one page
        rows = rows.where(F.col(FILE).isin(holding)) if holding else rows.where(F.lit(False))
    known = manifest.select(F.col(FILE).alias("_of"), "before")
    placed = rows.join(known, F.col(FILE) == F.col("_of")).withColumn(POSITION, F.col("before") + F.col(PLACE))
    placed = placed.drop("_of", "before", FILE, PLACE)
    if first is None:
        return placed
    return placed.where(F.col(POSITION).between(first, last - 1)).orderBy(POSITION)
