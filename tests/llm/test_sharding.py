"""Operator 6 against a plain two-pass shuffle, with equal records."""

import collections

import pytest
from pyspark.sql import functions as F

from tally.llm import sharding

SCHEMA = "doc_id long, text string, other string"


def places(df, **how):
    out = sharding.shard(df, 6, **how)
    return collections.Counter((r.doc_id, r.text, r.other, r.shard, r.slot) for r in out.collect())


def rows():
    some = [(i, f"text {i} " * (i % 40), "x") for i in range(600)]
    return some + [(None, None, None)] * 5 + [(7, "the same", "a")] * 400 + [(8, "the same", "a")] * 3 + [(8, "the same", "b")]


@pytest.mark.parametrize("bucket_bytes", [2000, 1 << 20])
def test_same_shards_for_any_split(spark, bucket_bytes):
    df = spark.createDataFrame(rows(), SCHEMA)
    first = places(df.repartition(1), bucket_bytes=bucket_bytes)
    assert sum(first.values()) == len(rows())
    assert places(df.repartition(7), bucket_bytes=bucket_bytes) == first == places(df.orderBy(F.rand(3)), bucket_bytes=bucket_bytes)
    counts = collections.Counter(s for *_, s, _ in first.elements())
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 6
    for s, n in counts.items():
        assert sorted(slot for *_, shard, slot in first.elements() if shard == s) == list(range(n))


def test_equal_records_spread_over_all_buckets(spark):
    """A third of all rows equal: every bucket gets its part, by Spark's own count."""
    df = spark.range(40_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("copy").alias("text"), F.lit("o").alias("other"))
    df = df.unionByName(spark.range(80_000).select("id", F.concat(F.lit("t"), "id"), F.lit("o")).toDF(*df.columns))
    out = sharding.shard(df, 24, bucket_bytes=20_000)
    by = out.groupBy("shard").agg(F.count_if(F.col("doc_id").isNull()).alias("equal"), F.count("*").alias("n")).collect()
    assert len(by) == 24 and all(r.n == 5000 and 1300 < r.equal < 2050 for r in by), by


def test_order_is_seeded_and_even(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("o").alias("other"))
    one, again, two = (places(df, bucket_bytes=4000, seed=s) for s in (1, 1, 2))
    assert one == again != two
    firsts = [d for (d, _, _, s, _) in one.elements() if s == 0]
    assert 700 < sum(firsts) / len(firsts) < 1300  # the first shard holds no run of ids
    assert sharding.shard(df.limit(0)).count() == 0


def test_writing_shards_of_nothing(spark, tmp_path):
    sharding.write_shards(sharding.shard(spark.createDataFrame([], SCHEMA)), f"{tmp_path}/s")
    assert not list(tmp_path.glob("s/shard=*"))
    odd = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit(1).alias("o"),
                                 F.create_map(F.lit("k"), "id").alias("copy"))
    out = sharding.shard(odd, 3).collect()
    assert len(out) == 50 and all(r.copy == {"k": r.doc_id} and r.o == 1 for r in out)
