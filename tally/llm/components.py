"""Connected components of a links table, by label spreading with pointer jumping.

Every node starts with the smallest of its neighbours and itself; each round
it takes the smallest label around it and then the label of its label, until
nothing changes (about the logarithm of the longest path).  Every round is a
few equi-joins and partial minimums on long numbers; rounds are cut with
reliable checkpoints, so a lost executor costs one round at most.  Only a
count of changes comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.shared import cut


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (its smallest node) of every node of a link; an empty
    table of links gives no rows, self-links and repeated links do no harm."""
    one = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    around = cut(one.union(one.select("y", "x")).distinct())
    labels = cut(around.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("label"))
                 .select(F.col("x").alias("node"), "label"))
    while True:
        heard = (
            around.join(labels, around["y"] == labels["node"]).groupBy("x").agg(F.min("label").alias("heard"))
            .withColumnRenamed("x", "node"))
        lower = labels.join(heard, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        target = labels.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        stepped = cut(lower.join(target, "label").select(
            "node", "old", F.least("label", "jump").alias("label")))
        changed = stepped.where("old <> label").count()
        labels = stepped.select("node", "label")
        if not changed:
            return labels.withColumnRenamed("label", "component")
