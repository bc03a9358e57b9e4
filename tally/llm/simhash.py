"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint takes its bits by majority over the XXH64 hashes (seed 42) of
all word shingles of the whole text.  Two fingerprints at most ``radius`` bits
apart have a variant in common that is within ``radius // 2`` flipped bits of
one and the rest of the radius of the other, so each fingerprint emits all
variants within half the radius and equal variants meet.

Variants are shuffled by their leading ``prefix_bits``: a distinct fingerprint
is sent once to each prefix some variant of its has, and the task of a prefix
writes out the variants that start with it, sorts them and links the members
of each run.  With an even radius members of a run are within the radius of
each other by the triangle inequality; every link is still verified by its
bit distance.  Of a run only links to its first member leave the task, and of
these only a spanning forest of the prefix, never all pairs; the components
of all forests are those of all links.

Scale: equal fingerprints are one row before anything is emitted, so copies
cost nothing.  ``prefix_bits`` grows until no prefix receives more than
``GROUP_ROWS`` fingerprints, and the task of a prefix works in slices of at
most ``SLICE`` variants.

Defined results: null and blank texts have fingerprint zero and are linked
like any other; with fewer words than a shingle the whole sequence is one
shingle; rows with equal ids keep their own rows; a component of rows without
ids has a null component_id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.components import connected_components
from tally.llm.shared import cut, documents, fresh
from tally.operators.joins import lookup_join

SHINGLE, RADIUS, SEED = 4, 4, 42
PREFIX_BITS = 10
GROUP_ROWS = 200_000
SLICE = 4_000_000


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a text as a signed 64-bit number."""
    words = text.encode("utf-8").lower().split() if text else []  # bytes: A-Z and \\x20\\x09-\\x0D only
    if not words:
        return 0
    hash64 = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [hash64(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[:-1] + 1).tolist()]
        hashes = [hash64(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1:].tolist())]
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 100_000):
        part = np.array(hashes[at:at + 100_000], "<u8")
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<i8")[0])


def _masks(bits: int, most: int) -> list[np.ndarray]:
    """For r = 0 .. most: every number below 2**bits with r bits set."""
    return [np.array([sum(1 << b for b in c) for c in combinations(range(bits), r)], np.uint64)
            for r in range(most + 1)]


def prefixes(bits: int, half: int) -> list[tuple[int, int]]:
    """(mask on the leading bits, flips) of all variants' prefixes."""
    return [(int(m), r) for r, masks in enumerate(_masks(bits, min(half, bits))) for m in masks]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the graph with links (a, b): each node with its component's smallest."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[:len(a)], ends[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while (new != (jumped := new[new])).any():
            new = jumped
        if (new == label).all():
            break
        label = new
    out = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[out]], nodes[out]


def _links(prefix: int, flips: np.ndarray, prints: np.ndarray, bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links found among the variants with one prefix."""
    half, low_bits = radius // 2, 64 - bits
    low = prints & np.uint64((1 << low_bits) - 1)
    masks = _masks(low_bits, half)
    # slices of the variants by their next leading bits bound what is held at once
    total = sum(int((flips == f).sum()) * sum(map(len, masks[:half - f + 1])) for f in range(half + 1))
    slice_bits = max(0, int(np.ceil(np.log2(max(total, 1) / SLICE))))
    found_a, found_b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    for part in range(1 << slice_bits):
        variants, owners = [], []
        for f in range(half + 1):
            mine = np.flatnonzero(flips == f)
            for group in masks[:half - f + 1]:
                for at in range(0, len(mine), max(1, SLICE // max(1, len(group)))):
                    some = mine[at:at + max(1, SLICE // max(1, len(group)))]
                    v = low[some][:, None] ^ group[None, :]
                    if slice_bits:
                        kept = (v >> np.uint64(low_bits - slice_bits)) == np.uint64(part)
                        variants.append(v[kept])
                        owners.append(np.broadcast_to(some[:, None], v.shape)[kept])
                    else:
                        variants.append(v.ravel())
                        owners.append(np.repeat(some, len(group)))
        variant, owner = np.concatenate(variants), np.concatenate(owners)
        order = np.argsort(variant, kind="stable")
        variant, owner = variant[order], owner[order]
        same = np.flatnonzero(variant[1:] == variant[:-1]) + 1  # members of a run but the first
        if not len(same):
            continue
        starts = np.flatnonzero(np.r_[True, variant[1:] != variant[:-1]])
        first = starts[np.searchsorted(starts, same, side="right") - 1]
        a, b = prints[owner[first]], prints[owner[same]]
        near = np.bitwise_count(a ^ b) <= radius
        if radius % 2:  # members of a run may be one bit too far apart: verify each with all
            raise ValueError("an even radius is needed")
        pairs = np.unique(np.stack([a[near], b[near]]), axis=1)
        a, b = _forest(pairs[0], pairs[1])
        found_a.append(a)
        found_b.append(b)
    return _forest(np.concatenate(found_a), np.concatenate(found_b))


def ball_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``a, b`` among the distinct fingerprints of column ``fp``, whose
    components are those of all pairs at most ``radius`` bits apart."""
    if radius % 2:
        raise ValueError("the radius must be even")
    half = radius // 2
    bits = PREFIX_BITS
    while bits < 24:
        keys = F.shiftrightunsigned("fp", 64 - bits)
        fullest = prints.groupBy(keys.alias("k")).count().agg(F.max("count")).first()[0] or 0
        if fullest * len(prefixes(bits, half)) <= GROUP_ROWS * 8 and fullest <= GROUP_ROWS:
            break
        bits += 4
    spread = prints.select("fp", F.explode(F.array(*[
        F.struct(F.lit(m).cast("long").alias("mask"), F.lit(f).cast("int").alias("flips"))
        for m, f in prefixes(bits, half)])).alias("s")).select(
            F.shiftrightunsigned("fp", 64 - bits).bitwiseXOR(F.col("s.mask")).alias("prefix"),
            F.col("s.flips").alias("flips"), "fp")

    def link(key, rows: pd.DataFrame) -> pd.DataFrame:
        a, b = _links(key[0], rows["flips"].to_numpy(), rows["fp"].to_numpy().view(np.uint64), bits, radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return spread.groupBy("prefix").applyInPandas(link, "a long, b long").distinct()


def components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` of every row."""

    @F.pandas_udf("long")
    def prints_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    marked = cut(docs.select(F.col(id_col).alias("doc_id"), prints_of(F.col(text_col)).alias("fp")))
    prints = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    linked = connected_components(ball_links(prints.select("fp"), radius))
    roots = (
        prints.join(linked.withColumnRenamed("node", "fp"), "fp", "left")
        .withColumn("root", F.coalesce("component", "fp")))
    smallest = roots.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = lookup_join(roots, smallest.withColumnRenamed("root", "of"), "root", "of", "inner").select(
        "fp", "component_id")  # a component may hold a third of the fingerprints
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the smallest id (rows
    without id last), among equal ids the smallest hash of the row."""
    key, = fresh(docs, "key")
    plain = [c for c, kind in docs.dtypes if "map<" not in kind]  # maps have no hash
    keyed = docs.withColumn(key, F.struct(
        F.col(id_col).isNull().alias("last"), F.col(id_col).cast("long").alias("id"),
        F.xxhash64(*plain).alias("row")))
    groups = components(keyed.select(key, text_col), id_col=key, text_col=text_col, **options)
    first = groups.select(F.col("component_id").alias(key)).distinct()
    return keyed.join(first, key, "left_semi").dropDuplicates([key]).select(*docs.columns)


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    out = components(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
