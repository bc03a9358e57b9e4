"""Cutting a large table to the keys of a selection without shuffling it.

J5 reads all invoice items of all time, though a report lists the lines of one
period, item or customer.  :func:`within` keeps the rows whose key may be among
the selected ones, by a bitmap of key hashes (a Bloom filter of one hash).  J2
likewise looks up the vouchers of all payments among the few return invoices;
:func:`maybe_in` marks those that may be there:

* the bitmap is built by Spark's own bitmap aggregates, one 4 KB piece per
  32,768 hash values, combined map-side;
* it has at most ``bits / 8`` bytes (16 MB at the default), however many keys are
  selected: that bound is what makes its broadcast safe;
* a row that fails the test can match no selected key, so it never reaches
  the aggregate or its shuffle.  Rows that pass by chance (a share of
  about selected keys / bits) are sorted out by the exact join that follows.

With far more selected keys than bits nearly every row passes, and the result
is still right.  Keys that carry a collation are not cut: equal ones may have
other bytes.

The bitmap has to be ready before the large table is scanned, so it pays from some
size on: :func:`worth_cutting` asks Catalyst for the table's size, like Spark's own
runtime filters (``tally.keyset.minBytes``, 10 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 27
PIECE_BITS = 32_768  # fixed by Spark's bitmap functions


MIN_BYTES = 10 << 30


def worth_cutting(df: DataFrame) -> bool:
    """Whether the files ``df`` reads (its pruned columns of them) are estimated
    at ``tally.keyset.minBytes`` or more together.  The estimate of a join is no use here:
    Catalyst multiplies the sizes of its sides."""
    if df.isStreaming:
        return False
    least = int(df.sparkSession.conf.get("tally.keyset.minBytes", str(MIN_BYTES)))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())) >= least


def _hash(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits)) + 1


def _collated(df: DataFrame, key: str) -> bool:
    return getattr(df.schema[key].dataType, "collation", "UTF8_BINARY") != "UTF8_BINARY"


def key_bitmap(keys: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """``_piece, _bitmap`` over the hashes of ``key``: bits / 32,768 rows at most."""
    if bits % PIECE_BITS:
        raise ValueError(f"bits must be a multiple of {PIECE_BITS}")
    h = _hash(F.col(key), bits)
    return keys.where(F.col(key).isNotNull()).groupBy(F.bitmap_bucket_number(h).alias("_piece")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(h)).alias("_bitmap"))


def maybe_in(df: DataFrame, key: str, keys: DataFrame, keys_key: str, flag: str, bits: int = BITS) -> DataFrame:
    """``df`` with boolean ``flag``: false only where ``key`` is none of the
    ``keys_key`` of ``keys`` for certain.  A NULL key is none; a collated one always may be."""
    if _collated(df, key) or _collated(keys, keys_key):
        return df.withColumn(flag, F.col(key).isNotNull())
    h = _hash(F.col(key), bits)
    bitmap = F.broadcast(key_bitmap(keys, keys_key, bits))
    byte = F.conv(F.hex(F.substring("_bitmap", (F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1
    return (
        df.withColumns({"_at": F.bitmap_bucket_number(h), "_bit": F.bitmap_bit_position(h)})
        .join(bitmap, F.col("_at") == F.col("_piece"), "left")
        .select(*df.columns, F.coalesce(hit, F.lit(False)).alias(flag))
    )


def within(df: DataFrame, key: str, keys: DataFrame, keys_key: str, bits: int = BITS) -> DataFrame:
    """The rows of ``df`` whose ``key`` may be a ``keys_key`` of ``keys``: all
    that are, and few others."""
    return maybe_in(df, key, keys, keys_key, "_may", bits).where("_may").drop("_may")
