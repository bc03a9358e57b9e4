"""The report's total row.

The reference asks its framework for a total row over the numeric columns
(and its print view re-sums the detail rows).  Here one aggregate with the
grouping sets ``((key), ())`` over the kept rows gives both: the rows are
computed once, the total is summed map-side, and an empty report gets no
total row (a grouping set of no rows has no group).  The frame gains
``is_total`` (1 on the total), because the total row and the NULL customer
group both have a NULL name.

That suits reports of one row per customer.  The item reports list order
lines: there an Expand would copy every line and shuffle whole records, so
:func:`column_totals` sums a narrow frame of the same lines and
:func:`with_total_beside` puts the total next to the untouched detail rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType


def with_total_row(detail: DataFrame, key: str, sums: Sequence[str]) -> DataFrame:
    """``detail`` (one row per ``key``) and the row of the totals of ``sums``;
    the total has NULL in all other columns."""
    others = [c for c in detail.columns if c != key and c not in sums]
    grouped = detail.groupingSets([[F.col(key)], []], F.col(key)).agg(
        F.grouping_id().alias("_gid"),
        *[F.sum(c).alias(c) for c in sums],
        F.first(F.struct(*others)).alias("_rest"),
    )
    detail_only = lambda c: F.when(F.col("_gid") == 0, F.col("_rest")[c]).alias(c)
    return grouped.select(
        *[detail_only(c) if c in others else F.col(c) for c in detail.columns],
        F.when(F.col("_gid") == 0, 0).otherwise(1).alias("is_total"),
    )


def column_totals(rows: DataFrame, sums: Mapping[str, DecimalType]) -> DataFrame:
    """The one row of totals of ``rows``, none if there are none.  Each column
    is summed exactly (as a decimal copy), map-side and then once more, and
    given back as DOUBLE."""
    totals = rows.agg(F.count(F.lit(1)).alias("_n"), *[F.sum(F.col(c).cast(t)).alias(c) for c, t in sums.items()])
    return totals.where("_n > 0").select(*[F.col(c).cast("double").alias(c) for c in sums])


def with_total_beside(detail: DataFrame, total: DataFrame) -> DataFrame:
    """``detail`` as it is and the row of ``total``, whose other columns are NULL."""
    both = detail.withColumn("is_total", F.lit(0)).unionByName(
        total.withColumn("is_total", F.lit(1)), allowMissingColumns=True)
    return both.select(*detail.columns, "is_total")
