"""Fractional quantities stay exact to nine decimals through every factor."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tally.operators import orders as ords
from tally.operators.ledger import adjustment_totals


def test_nine_decimals_survive_the_fan_out_factor(spark):
    df = spark.createDataFrame([("L1", 0.123456789, 2, 2), ("L2", 0.000000001, None, 3)],
                               "soi_name string, qty double, _mapped long, _graded long")
    got = (df.withColumn("_billed_raw", F.sum(F.col("qty").cast(ords.QTY)).over(
        Window.partitionBy("soi_name")))
        .select("soi_name", ords.billed_qty(True).alias("b")).collect())
    assert {r.soi_name: r.b for r in got} == {"L1": 0.493827156, "L2": 3e-09}


def test_accounts_with_one_scrubbed_name_keep_the_last(spark):
    adj = spark.createDataFrame([("A", "Write Off", 1.0), ("A", "Write-Off", 2.0)],
                                "customer_name string, account string, amount double")
    row = adjustment_totals(adj, ["Write Off", "Write-Off"]).first().asDict()
    assert row["_adj_total"] == 3.0 and len(row) == 3
    assert [v for k, v in row.items() if k not in ("_adj_name", "_adj_total")] == [2.0]
