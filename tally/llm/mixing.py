"""Mixing sources to target weights by systematic sampling (DataFrame only).

Every source gets a target number of words; a document's expected copies are
its source's target over the source's size.  Within a source the documents
stand in the order (size, seeded hash of the id, hash of the text); the prefix sums of expected
copies plus one random offset a source cross integer boundaries, and each
crossing emits the document once.  Because the order goes by size, what a
source takes stays within about one longest document of its target.

Scale: no window ever holds a source.  Counts are first aggregated by
(source, size, first hash digits), the prefix sums run over these counts (one
row a distinct size and source), and the rows of one such cell alone are
numbered in a window.  A source, a size or a group of copies with a third of
all rows is spread over its sizes and hash cells: 256 for each size, and as
many more as hold its cells to about ``CELL_ROWS`` rows (the order, hence the
result, is the same for any number of cells).  Rows that share even the id
are told apart by their texts, and repeated rows, which are interchangeable,
by the partition they are stored in then, so none of them is one task's load.

Defined results: null text is empty (size 0, taken 0); null source is a
source of its own, last in order; a null id hashes as the empty string; rows
that agree in id and text are interchangeable; an empty table gives an empty
result; a corpus without words has targets 0 and takes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tally.llm.shared import cut, fresh, stored, word_count

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = "mix-1"
CELL_ROWS = 1 << 20
CELL_DIGITS = 2  # hex digits of the hash that make a cell, where no cell is above CELL_ROWS
PARTS_A_FILE = 8  # shuffle partitions whose counts make a checkpoint file; without Hadoop's native library a file starts a process
_OFFSET_HEX = 5  # the offset is a multiple of 16**-5, so prefix sums stay exact in doubles


def source_key(source: Column) -> Column:
    """A never-null key that sorts sources by code point, null last."""
    return F.when(source.isNull(), F.lit("b")).otherwise(F.concat(F.lit("a"), source))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``source_key, source_size`` (one row a source) -> adds ``target``.

    Shares the sum of all sizes by the weights (repeated in key order).  A
    target stops at ``max_repeats`` times its source's size and the excess is
    shared again by weight until none is above: in the order of cap / weight a
    source is capped when its cap is at most its share of what the capped ones
    before it leave.
    """
    everything = W.orderBy("source_key")
    weighted = (
        sizes.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (
            (F.row_number().over(everything) - 1) % len(weights) + 1).cast("int")).cast("long"))
        .withColumn("cap", F.col("source_size") * max_repeats))
    order = W.orderBy(F.col("cap") / F.col("weight"), "source_key")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    onward = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    all_rows = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    stepped = (
        weighted.withColumn("total", F.sum("source_size").over(all_rows))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("capped", F.col("cap") * F.sum("weight").over(onward) <= F.col("left") * F.col("weight")))
    kept_weight = F.sum(F.when(~F.col("capped"), F.col("weight")).otherwise(0)).over(all_rows)
    kept_words = F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(all_rows)
    return stepped.select(
        "source_key", "source_size",
        F.when(F.col("capped"), F.col("cap").cast("double"))
        .otherwise((kept_words * F.col("weight")).cast("double") / kept_weight).alias("target"))


def offset(seed: str, key: Column) -> Column:
    """The random offset of a source, in [0, 1)."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), key)), 1, _OFFSET_HEX)
    return F.conv(digits, 16, 10).cast("double") / float(16 ** _OFFSET_HEX)


def _finer(cells: DataFrame, by: list[str], digits: str) -> DataFrame:
    """``_of`` (the struct of ``by``), ``digits``: hash digits that the sizes with
    a cell above ``CELL_ROWS`` need; no more than one row for each ``CELL_ROWS`` rows of the input."""
    return (cells.groupBy(*by).agg(F.max("n").alias("n")).where(F.col("n") > CELL_ROWS)
            .select(F.struct(*by).alias("_of"),
                    (F.lit(CELL_DIGITS) + F.ceil(F.log2(F.col("n") / CELL_ROWS) / 4)).cast("int").alias(digits)))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, dict[str, str]]:
    """Every input row with its copies; returns the frame and the names of the
    added columns ``size, source_size, target, copies`` (chosen not to clash).

    ``weights`` are positive whole numbers.  ``copies`` says how often the mix
    takes the row; see :func:`mixed_rows` for the emitted rows themselves.
    """
    names = fresh(docs, "size", "source_size", "target", "copies", "source_key", "hash", "part", "cell", "rank",
                  "start", "rate", "offset", "digits", "of")
    size, source_size, target, copies, skey, hashed, part, cell, rank, start, rate, off, digits, of = names
    keyed = (
        docs.withColumn(size, word_count(F.col(text_col)))
        .withColumn(skey, source_key(F.col(source_col)))
        .withColumn(hashed, F.concat(
            F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))),
            F.md5(F.coalesce(F.col(text_col), F.lit("")))))
        .withColumn(cell, F.substring(hashed, 1, CELL_DIGITS)))
    files = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // PARTS_A_FILE)
    count = lambda: cut(keyed.groupBy(skey, size, cell).agg(F.count("*").alias("n")).coalesce(files))
    cells = count()
    if (cells.agg(F.max("n")).first()[0] or 0) > CELL_ROWS:
        finer = _finer(cells, [skey, size], digits).withColumnRenamed("_of", of)
        # A join on the struct: both sides get a shuffle of their own, which Spark can split.
        keyed = keyed.join(finer, F.struct(skey, size) == F.col(of), "left").withColumn(
            cell, F.substring(hashed, F.lit(1), F.coalesce(F.col(digits), F.lit(CELL_DIGITS)))).drop(of, digits)
        cells = count()
        stuck = cells.where(F.col("n") > 2 * CELL_ROWS).select(F.struct(skey, size, cell).alias(of))
        if not stuck.isEmpty():  # equal ids; stored, so that a row's partition is the same in every later run
            keyed = stored(keyed.withColumn(part, F.lpad(F.spark_partition_id().cast("string"), 10, "0")), "mixing")
            keyed = keyed.join(stuck, F.struct(skey, size, cell) == F.col(of), "left").withColumn(
                cell, F.when(F.col(of).isNull(), F.col(cell)).otherwise(F.concat(hashed, part))).drop(of)
            cells = count()
    sized = cells.groupBy(skey, size).agg(F.sum("n").alias("n"))
    sources = targets(
        sized.groupBy(F.col(skey).alias("source_key")).agg(F.sum(F.col(size) * F.col("n")).alias("source_size")),
        weights, max_repeats).select(
            F.col("source_key").alias(skey), F.col("source_size").alias(source_size), F.col("target").alias(target),
            F.when(F.col("source_size") > 0, F.least(
                F.col("target") / F.col("source_size"), F.lit(float(max_repeats)))).otherwise(0.0).alias(rate),
            offset(seed, F.col("source_key")).alias(off))
    earlier = W.unboundedPreceding, -1
    size_start = sized.select(skey, size, F.coalesce(F.sum("n").over(
        W.partitionBy(skey).orderBy(size).rowsBetween(*earlier)), F.lit(0)).alias("size_start"))
    plan = (
        cells.withColumn("cell_start", F.coalesce(F.sum("n").over(
            W.partitionBy(skey, size).orderBy(cell).rowsBetween(*earlier)), F.lit(0)))
        .join(size_start, [skey, size]).join(sources, skey)
        .select(skey, size, cell, (F.col("size_start") + F.col("cell_start")).alias(start),
                source_size, target, rate, off))
    numbered = keyed.withColumn(rank, F.row_number().over(
        W.partitionBy(skey, size, cell).orderBy(hashed)))
    place = F.col(start) + F.col(rank)
    crossed = (F.floor(place * F.col(rate) + F.col(off)) - F.floor((place - 1) * F.col(rate) + F.col(off)))
    out = numbered.join(plan, [skey, size, cell]).withColumn(copies, crossed.cast("long"))
    added = {"size": size, "source_size": source_size, "target": target, "copies": copies}
    return out.select(*docs.columns, *added.values()), added


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, same columns."""
    out, names = mix(docs, **options)
    return (out.where(F.col(names["copies"]) > 0)
            .withColumn(names["copies"], F.explode(F.sequence(F.lit(1).cast("long"), F.col(names["copies"]))))
            .select(*docs.columns))


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    from tally.llm.shared import documents

    out, c = mix(documents(spark, sf_dir))
    return out.select(
        "doc_id", F.col(c["size"]).alias("size"), F.col(c["source_size"]).alias("source_size"),
        F.col(c["target"]).alias("target"), (F.col(c["copies"]) * F.col(c["size"])).alias("taken"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         CASE WHEN source IS NULL THEN 'b' ELSE 'a' || source END AS k,
         md5('mix-1' || coalesce(doc_id::VARCHAR, '')) AS h, md5(coalesce(text, '')) AS t
  FROM documents),
s AS (SELECT k, sum(size)::BIGINT AS source_size FROM d GROUP BY k),
w AS (SELECT k, source_size, source_size * 3 AS cap,
             [5, 2, 1][((row_number() OVER (ORDER BY k) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM s),
f AS (SELECT *, sum(source_size) OVER ()::BIGINT AS total,
             coalesce(sum(cap) OVER (ORDER BY cap / weight::DOUBLE, k
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS gone,
             sum(weight) OVER (ORDER BY cap / weight::DOUBLE, k
                      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS heavy FROM w),
g AS (SELECT *, cap * heavy <= (total - gone) * weight AS capped FROM f),
p AS (SELECT k, source_size,
             CASE WHEN capped THEN cap::DOUBLE ELSE
               ((total - coalesce(sum(cap) FILTER (capped) OVER (), 0)::BIGINT) * weight)::DOUBLE
               / (sum(weight) FILTER (NOT capped) OVER ())::BIGINT END AS target,
             ('0x' || substr(md5('mix-1' || k), 1, 5))::BIGINT / 1048576.0::DOUBLE AS u FROM g),
r AS (SELECT d.*, p.source_size, p.target, p.u,
             CASE WHEN p.source_size > 0 THEN least(p.target / p.source_size, 3.0::DOUBLE) ELSE 0 END AS rate,
             row_number() OVER (PARTITION BY d.k ORDER BY d.size, d.h, d.doc_id, d.t) AS i
      FROM d JOIN p USING (k))
SELECT doc_id, size, source_size, target,
       ((floor(i * rate + u) - floor((i - 1) * rate + u))::BIGINT * size) AS taken
FROM r
"""
