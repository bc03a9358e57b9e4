"""Sharding by a two-pass external shuffle (DataFrame only).

Pass one scatters the records uniformly into memory-sized buckets with a
seeded hash of all their columns; the bucket count follows from the bytes of
the whole input.  Pass
two gathers one bucket a time, puts its records in a fixed order, permutes
them by Fisher-Yates (Spark's seeded ``shuffle`` of an array) and writes the
bucket to the shared folder.  The buckets in order are one random order of all
records, and shard s of n holds the positions from ceil(s N / n): the ``rows``
law, counts at most one apart, slots gapless from 0.

Scale: a bucket holds ``bucket_bytes`` on average whatever the input.  Equal
records have equal hashes; those that would take over ``1 / COPY_SHARE`` of a
bucket together are counted and kept once, and every copy is scattered by the
hash and its running number.  So they spread like any others, only one of
them moves, and nothing hangs on how the input is split: any file or
partition layout gives the same shards.  The hashes of such copies (``COPY_SHARE`` for
each bucket at most) and the bucket counts are joined by broadcast only while they are
under ``BROADCAST_BYTES``, else by an equi-join.

Defined results: a null text has no bytes (size 8, CRC 0); ids may be null or
repeat; an empty table gives no rows; columns of the input named ``shard`` or
``slot`` are replaced by the operator's; columns with maps take no part in the hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tally.llm.shared import documents, stored

BUCKET_BYTES = 16 << 20
BROADCAST_BYTES = 8 << 20
COPY_SHARE = 8
SHARDS = 24
SEED = 20_240_607


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text plus 8."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def shard(records: DataFrame, n_shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All records in shuffled order: their columns, ``shard`` and ``slot``."""
    total = records.agg(F.coalesce(F.sum(record_size(F.col(text_col))), F.lit(0)).alias("bytes"),
                        F.count("*").alias("rows")).first()
    n_rows, n_buckets = total["rows"], max(1, math.ceil(total["bytes"] / bucket_bytes))
    columns = [c for c in records.columns if c not in ("shard", "slot")]
    hashed = [c for c, kind in records.dtypes if c in columns and "map<" not in kind]
    record = F.struct(*[F.col(c) for c in columns])
    rows = records.select(F.xxhash64(F.lit(seed), *hashed).alias("h"), record.alias("record"),
                          record_size(F.col(text_col)).alias("size"))
    many = (rows.groupBy("h").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
            .where(F.col("size") * COPY_SHARE > bucket_bytes).where("n > 1").select(F.col("h").alias("many")))
    if 16 * COPY_SHARE * n_buckets <= BROADCAST_BYTES:  # no more than COPY_SHARE hashes a bucket's bytes
        many = F.broadcast(many)
    marked = rows.join(many, rows["h"] == many["many"], "left")
    copies = (marked.where("many is not null").groupBy("h").agg(F.first("record").alias("record"), F.count("*").alias("n"))
              .select("h", "record", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy")))
    dealt = marked.where("many is null").select("h", "record", F.lit(0).cast("long").alias("copy")).unionByName(copies)
    order = F.xxhash64(F.lit(seed + 1), F.col("h"), F.col("copy"))
    bucket = F.pmod(F.xxhash64(F.col("h"), F.col("copy")), F.lit(n_buckets))
    buckets = (
        dealt.select(bucket.alias("bucket"), F.struct(order.alias("o"), "copy", "record").alias("record"))
        .groupBy("bucket").agg(_in_order(F.collect_list("record"), len(hashed) == len(columns)).alias("records"))
        .sortWithinPartitions("bucket"))
    written = stored(
        buckets.select("bucket", F.size("records").cast("long").alias("n"),
                       F.shuffle("records", seed).alias("records")), "shuffled")
    starts = written.select("bucket", F.coalesce(
        F.sum("n").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    if 16 * n_buckets <= BROADCAST_BYTES:
        starts = F.broadcast(starts)
    # whole numbers throughout: shard s starts at the first position p with p * n_shards div n_rows = s
    return (
        written.select("bucket", F.posexplode("records").alias("at", "record")).join(starts, "bucket")
        .withColumn("position", F.col("start") + F.col("at"))
        .withColumn("shard", F.expr(f"position * {n_shards} div {max(n_rows, 1)}"))
        .select(*[F.col("record")["record"][c].alias(c) for c in columns], F.col("shard").cast("int").alias("shard"),
                F.expr(f"position - (shard * {n_rows} + {n_shards - 1}) div {n_shards}").alias("slot")))


def _in_order(records: Column, comparable: bool) -> Column:
    """Records by their order number; those with maps can't be compared as a whole."""
    if comparable:
        return F.sort_array(records)
    less = lambda a, b: (a["o"] < b["o"]) | ((a["o"] == b["o"]) & (a["copy"] < b["copy"]))
    return F.array_sort(records, lambda a, b: F.when(less(a, b), -1).when(less(b, a), 1).otherwise(0))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard; positions within a bucket are consecutive, so each
    task writes to few shards.  Rows carry their slot."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    out = shard(documents(spark, sf_dir))
    return out.select(
        "doc_id", record_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
