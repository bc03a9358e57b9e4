"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots.  Every vector is
posted in the inverted files of its ``posts`` nearest pivots; a query opens
the files of its ``probes`` nearest pivots, ranks each file by the footrule
distance over the query's first ``LENGTH`` pivots (a pivot outside a row's
order counts as the order's length), and computes the exact cosine for the
best ``rerank`` of each file.  The best k of all files are returned; a query
that found fewer than k though more rows exist searches all files.  The exact
setting is ``posts=1, probe_share=1`` and a ``rerank`` of all rows: every file
is opened and every cosine in it computed.

The pivots are a bounded sample (``MOST_PIVOTS`` at most) of the distinct
vectors, the smallest by hash; every row is indexed.  Their number is about
twice the square root of the rows, and a query opens ``PROBES`` times the
square root of their number (or the share ``1 / probe_share`` of them, where
given).  So, up to ``MOST_PIVOTS``, the rows ranked for a query grow as the
table to the power 0.75.  Where the files opened would list as many rows as
the table has, each row is posted once and all files are opened instead: no
more work, and no file is missed.

Scale: a file with more than ``FILE_ROWS`` vectors is split into blocks by a
hash of the id, one with more than ``QUERY_ROWS`` queries by a hash of theirs,
and every block meets every query block of its file: a vector that makes up a
third of the table is spread like any other.  Small files are searched by the
``GROUP_ROWS`` in one group; files that no query opens are not sent.  The
pivots (bounded) and a count for each are all the driver sees.

Defined results: vectors that are null, zero, of another length than the most
frequent, or hold null or non-finite components take no part, nor do rows
without id; rows with the query's id are its own; an id that repeats counts
once a query, with its best score, and queries with the smallest of its
vectors; ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from tally.llm.shared import cut, documents, stored

LEAST_PIVOTS, MOST_PIVOTS = 64, 4096
POSTS, PROBES, RERANK, LENGTH = 2, 8, 128, 128  # a footrule, at most LENGTH squared, has 16 bits
FILE_ROWS, QUERY_ROWS, GROUP_ROWS = 20_000, 5_000, 4_000
CELLS = 1 << 18  # pivot positions compared at once
QUERY_EVERY, NEAREST = 50, 5


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def wanted_pivots(n_rows: int) -> int:
    return min(MOST_PIVOTS, max(LEAST_PIVOTS, 1 << math.ceil(math.log2(max(1.0, 2 * math.sqrt(n_rows))))))


def files_met(n_pivots: int, posts: int = POSTS, probe_share: int | None = None) -> tuple[int, int]:
    """Files in which a row is posted, and files that a query opens."""
    probes = n_pivots // probe_share if probe_share else math.ceil(PROBES * math.sqrt(n_pivots))
    posts = min(posts, n_pivots)
    probes = min(n_pivots, max(1, probes, posts))
    return (1, n_pivots) if posts * probes >= n_pivots else (posts, probes)


def _orders(pivots: np.ndarray, length: int, files: int, kind: str):
    """Per batch: vectors and the first ``length`` of their nearest pivots as bytes, and the first ``files``."""
    kept = max(length, files)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            vectors = np.stack(batch["embedding"].to_numpy())
            far = -(_unit(vectors.astype(np.float64)) @ pivots.T)
            if kept < far.shape[1]:
                near = np.sort(np.argpartition(far, kept - 1, axis=1)[:, :kept], axis=1)
                order = np.take_along_axis(
                    near, np.argsort(np.take_along_axis(far, near, axis=1), axis=1, kind="stable"), axis=1)
            else:
                order = np.argsort(far, axis=1, kind="stable")
            yield pd.DataFrame({"vec_id": batch["vec_id"], "vector": [v.tobytes() for v in vectors.astype(kind)],
                                "pivots": [o.tobytes() for o in order[:, :length].astype("<i2")],
                                "files": list(order[:, :files].astype(np.int32))})

    return run


def _search_files(width: int, pivots: int, length: int, k: int, rerank: int, kind: str):
    """Ranks some inverted files, or one block of one, each for its queries (or one block of them)."""
    places = np.arange(length, dtype=np.int16)

    def parts(rows: pd.DataFrame):
        vectors = np.frombuffer(b"".join(rows["vector"]), kind).reshape(-1, width).astype(np.float64)
        orders = np.frombuffer(b"".join(rows["pivots"]), "<i2").reshape(-1, length)
        return (rows["pivot"].to_numpy(), rows["vec_id"].to_numpy(), vectors,
                np.sqrt((vectors * vectors).sum(axis=1)), orders)

    def search_file(listed, queries) -> Iterator[tuple[np.ndarray, ...]]:
        ids, vectors, norms, orders = listed
        n, once = len(ids), len(np.unique(ids)) == len(ids)
        ranked = n > rerank
        if ranked:
            ranks = np.full((pivots, n), length, np.int16)
            ranks[orders.T, np.arange(n)] = places[:, None]
        step = max(1, CELLS // (n * length))
        for at in range(0, len(queries[0]), step):
            q_ids, q, q_norms, q_orders = (x[at:at + step] for x in queries)
            best = np.broadcast_to(np.arange(n), (len(q_ids), n))
            if ranked:
                apart = np.take(ranks, q_orders, axis=0)
                apart -= places[:, None]
                footrule = np.add.reduce(np.abs(apart, out=apart), axis=1, dtype=np.int16).astype(np.int64)
                footrule[q_ids[:, None] == ids] = length * length + 1  # a query's own rows come last
                best = np.argpartition(footrule * n + best, rerank - 1, axis=1)[:, :rerank]  # ties by id
            far = -(vectors[best] * q[:, None, :]).sum(axis=2) / (norms[best] * q_norms[:, None])
            others = ids[best] != q_ids[:, None]
            far[~others] = np.inf
            if once and best.shape[1] > k:
                others &= ~(far > np.partition(far, k - 1, axis=1)[:, k - 1:k])
            asked, found = np.nonzero(others)
            yield q_ids[asked], ids[best[asked, found]], -far[asked, found]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["pivot", "vec_id"], kind="stable")
        opened, *queries = parts(rows[rows["is_query"]])
        posted, *listed = parts(rows[~rows["is_query"]])
        found = [(np.array([], np.int64), np.array([], np.int64), np.array([]))]
        for pivot in np.intersect1d(opened, posted):
            mine, theirs = (slice(*np.searchsorted(x, [pivot, pivot + 1])) for x in (posted, opened))
            found.extend(search_file([x[mine] for x in listed], [x[theirs] for x in queries]))
        best = pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*found)))))
        return (best.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
                .drop_duplicates(["query_id", "vec_id"]).groupby("query_id").head(k))

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = NEAREST, posts: int = POSTS, rerank: int = RERANK,
           probe_share: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of each row of
    ``queries`` (columns as ``vectors``)."""
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        v = F.col("embedding")
        return (df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
                .where(F.col("vec_id").isNotNull() & usable(v)))

    rows = clean(vectors)
    sizes = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, n_rows = sizes["n"], sizes["count"]
    of_width = F.size("embedding") == width
    rows = rows.where(of_width)
    hashed = rows.select(F.xxhash64("embedding").alias("h"), "embedding")
    smallest = hashed.select("h").distinct().orderBy("h").limit(wanted_pivots(n_rows))
    pivots = _unit(np.array([r["p"] for r in hashed.join(smallest, "h").groupBy("h").agg(
        F.min("embedding").alias("p")).orderBy("h").collect()], np.float64))
    n_pivots = len(pivots)
    posts, probes = files_met(n_pivots, posts, probe_share)
    length = min(n_pivots, LENGTH)
    floats = all(isinstance(df.schema[vector_col].dataType.elementType, FloatType) for df in (vectors, queries))
    kind = "<f4" if floats else "<f8"
    schema = "vec_id long, vector binary, pivots binary, files array<int>"
    indexed = stored(rows.mapInPandas(_orders(pivots, length, posts, kind), schema), "permutations")
    asked = stored(
        clean(queries).where(of_width).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
        .mapInPandas(_orders(pivots, length, probes, kind), schema), "queries")

    def counted(files: DataFrame) -> np.ndarray:
        """Rows of each pivot's file."""
        counts = dict(files.groupBy("pivot").count().collect())
        return np.array([counts.get(p, 0) for p in range(n_pivots)])

    def of_pivot(values: np.ndarray) -> Column:
        return F.element_at(F.expr(f"array({', '.join(map(str, values.tolist()))})"), F.col("pivot") + 1)

    def grouped(n_listed: np.ndarray, n_asked: np.ndarray) -> np.ndarray:
        """Numbers of the groups in which the files are searched, -1 for files without rows or queries."""
        both = np.where((n_listed > 0) & (n_asked > 0), n_listed + n_asked, 0)
        return np.where(both > 0, (np.cumsum(both) - both) // GROUP_ROWS, -1)

    run = _search_files(width, n_pivots, length, k, rerank, kind)

    def look(these: DataFrame, opened: Column, posted: int) -> DataFrame:
        listed = indexed.withColumn("pivot", F.explode(F.slice("files", 1, posted)))
        these = these.withColumn("pivot", F.explode(opened))
        n_listed, n_asked = counted(listed.select("pivot")), counted(these.select("pivot"))
        files, asks = (np.maximum(1, np.ceil(n / most)).astype(int)
                       for n, most in ((n_listed, FILE_ROWS), (n_asked, QUERY_ROWS)))

        def spread(df: DataFrame, own: np.ndarray, other: np.ndarray, mine: str, theirs: str, is_query: bool) -> DataFrame:
            return (
                df.withColumn("files", of_pivot(grouped(n_listed, n_asked))).where("files >= 0")
                .withColumn(mine, F.pmod(F.xxhash64("vec_id"), of_pivot(own)).cast("int"))
                .withColumn(theirs, F.explode(F.sequence(F.lit(0), of_pivot(other) - 1)))
                .select("files", "block", "query_block", "pivot", "vec_id", "vector", "pivots",
                        F.lit(is_query).alias("is_query")))

        both = spread(listed, files, asks, "block", "query_block", False).unionByName(
            spread(these, asks, files, "query_block", "block", True))
        return both.groupBy("files", "block", "query_block").applyInPandas(
            lambda rows: run(rows), "query_id long, vec_id long, score double")

    found = cut(look(asked, F.col("files"), posts).groupBy("query_id", "vec_id")
                .agg(F.max("score").alias("score")))
    enough = found.groupBy("query_id").count().where(F.col("count") >= min(k, n_rows - 1))
    short = asked.join(enough, asked["vec_id"] == enough["query_id"], "left_anti")
    if n_rows > 1 and not short.isEmpty():
        everywhere = F.sequence(F.lit(0), F.lit(n_pivots - 1))
        found = (found.unionByName(look(short, everywhere, 1))
                 .groupBy("query_id", "vec_id").agg(F.max("score").alias("score")))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op9_nearest(spark, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir, "embeddings")
    return search(rows, rows.where(F.col("vec_id") % QUERY_EVERY == 0))
