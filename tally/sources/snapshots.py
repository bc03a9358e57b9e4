"""Balance snapshots: prefix sums of the ledger at period ends (F5a + A1).

R1 and R2 need the whole history for one number, the opening balance.  Over a
ledger stored by month (``layout.write_monthly``), :class:`BalanceSnapshots` keeps for
chosen period ends (month ends, best) one row per (party type, company, party): the sums of debit and
credit up to that end and the first posting date.  A report from
``from_date`` on then reads one partition of the snapshots and the ledger's
months after it; everything up to a period end before ``from_date`` is
opening by the reports' own rule, so no other bucket is touched.

Files::

    <path>/balances/period_end=D/   the prefix sums, dense: every party with any earlier entry
    <path>/covered/period_end=D/    the ledger files of the period that ends at D (month, name, size,
                                    time of writing)

Both hold a row of nulls for every period.

``covered`` is written last and lists what was there *before* the ledger was
read, so a file that lands meanwhile counts as not covered.

A back-dated entry, a cancelled voucher or any other rewrite changes the
files of its month.  :meth:`stale_from` compares the present files (names, sizes and times;
no row is read) with the covered ones and gives the first month that differs; only
snapshots before it are used (:meth:`usable`), and :meth:`refresh` builds the
later ones anew from the last good one, reading only the ledger after it.

All sums are DECIMAL, so a report is the same with and without snapshots.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DateType,
    DecimalType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

from tally.operators import filters as flt
from tally.sources.layout import MONTH
from tally.sources.schemas import SCHEMAS, S, conform
from tally.sources.work import checkpointed

KEYS = ("party_type", "company", "party")
SUM = DecimalType(31, 9)  # what a sum of ledger amounts widens to
BALANCES = StructType([*(StructField(k, S) for k in KEYS), StructField("debit", SUM), StructField("credit", SUM),
                       StructField("first_posting_date", DateType()), StructField("period_end", DateType())])
COVERED = StructType([StructField(MONTH, DateType()), StructField("file", StringType()),
                      StructField("length", LongType()), StructField("written", TimestampType()),
                      StructField("period_end", DateType())])


def month_ends(first: dt.date, last: dt.date) -> list[dt.date]:
    """The last days of the months from ``first``'s on, up to ``last``."""
    ends, month = [], first.replace(day=1)
    while True:
        month = (month + dt.timedelta(days=32)).replace(day=1)
        end = month - dt.timedelta(days=1)
        if end > last:
            return ends
        ends.append(end)


class BalanceSnapshots:
    """Snapshots under ``path`` of the ledger stored by month under ``ledger``."""

    def __init__(self, spark: SparkSession, ledger: str, path: str):
        self.spark, self.ledger, self.path = spark, ledger.rstrip("/"), path.rstrip("/")

    def entries(self, after: dt.date | None = None, upto: dt.date | None = None) -> DataFrame:
        """The ledger, as its files are now; only the months that can hold
        entries dated later than ``after`` and up to ``upto`` are listed and read."""
        schema = StructType([*SCHEMAS["gl_entry"].fields, StructField(MONTH, DateType())])
        rows = self.spark.read.schema(schema).parquet(self.ledger)
        if after is not None:
            first = (after + dt.timedelta(days=1)).replace(day=1)
            rows = rows.where((F.col(MONTH) >= F.lit(first)) & (F.col("posting_date") > F.lit(after)))
        if upto is not None:
            rows = rows.where((F.col(MONTH) <= F.lit(upto)) & (F.col("posting_date") <= F.lit(upto)))
        return conform(rows, "gl_entry")

    def _table(self, name: str, schema: StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:  # nothing built yet; any other fault raises
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def balances(self, period_end: dt.date) -> DataFrame:
        """The prefix sums at ``period_end``: one partition is read."""
        return self._table("balances", BALANCES).where(F.col("period_end") == F.lit(period_end)).drop("period_end")

    def _files(self) -> DataFrame:
        """The ledger's present files: listed by the executors, not opened."""
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(self.ledger)
        return files.select(
            F.col(MONTH).cast("date").alias(MONTH), F.element_at(F.split("path", "/"), -1).alias("file"),
            "length", F.col("modificationTime").alias("written"))

    def ends(self) -> list[dt.date]:
        """The period ends there are (as many as were asked for)."""
        rows = self._table("covered", COVERED).where("file is null").select("period_end").distinct().collect()
        return sorted(r.period_end for r in rows)

    def stale_from(self) -> dt.date | None:
        """The first day of the first covered month whose files have changed,
        None if none has."""
        ends = self.ends()
        if not ends:
            return None
        was = self._table("covered", COVERED).where("file is not null").drop("period_end").withColumn("_side", F.lit(1))
        now = self._files().where(F.col(MONTH) <= F.lit(ends[-1])).withColumn("_side", F.lit(-1))
        one_side = was.unionByName(now).groupBy(MONTH, "file", "length", "written").agg(
            F.sum("_side").alias("_side")).where("_side <> 0")
        return one_side.agg(F.min(MONTH)).first()[0]

    def usable(self, from_date: dt.date) -> dt.date | None:
        """The latest sound period end before ``from_date``."""
        stale = self.stale_from()
        good = [e for e in self.ends() if e < from_date and (stale is None or e < stale)]
        return good[-1] if good else None

    def refresh(self, ends: Sequence[dt.date]) -> list[dt.date]:
        """Build the snapshots of ``ends`` that are missing or stale, and
        return them.  Reads the ledger after the last sound one before them."""
        known, stale = self.ends(), self.stale_from()
        sound = [e for e in known if stale is None or e < stale]
        todo = sorted((set(ends) | set(known)) - set(sound))
        if not todo:
            return []
        base = max((e for e in sound if e < todo[0]), default=None)
        todo = sorted(set(todo) | {e for e in sound if e > todo[0]})  # a new end between sound ones
        files = checkpointed(self._within(self._files(), MONTH, base, todo))
        read = flt.posted(self.entries(base, todo[-1])).where(F.coalesce("party", F.lit("")) != "")
        new = self._within(read, "posting_date", base, todo)
        moved = new.groupBy(*KEYS, "period_end").agg(
            F.sum("debit").alias("debit"), F.sum("credit").alias("credit"),
            F.min("posting_date").alias("first_posting_date"))
        if base is not None:
            moved = moved.unionByName(self.balances(base).withColumn("period_end", F.lit(base)))
        # A row of nulls in every period, so that an emptied one is replaced as well.
        self._store(self._prefix_sums(moved, todo).unionByName(self._marks(todo, BALANCES)), "balances", BALANCES)
        self._store(files.select(*COVERED.names).unionByName(self._marks(todo, COVERED)), "covered", COVERED)
        return todo

    def _marks(self, ends: list[dt.date], schema: StructType) -> DataFrame:
        return self.spark.createDataFrame([(*[None] * (len(schema) - 1), e) for e in ends], schema)

    @staticmethod
    def _within(df: DataFrame, date: str, base: dt.date | None, ends: list[dt.date]) -> DataFrame:
        """The rows dated after ``base`` up to the last end, with the end of their period."""
        rows = df.where(F.col(date) <= F.lit(ends[-1]))
        if base is not None:
            rows = rows.where(F.col(date) > F.lit(base))
        known = F.array(*[F.lit(e) for e in ends])
        return rows.withColumn("period_end", F.array_min(F.filter(known, lambda e: e >= F.col(date))))

    @staticmethod
    def _prefix_sums(moved: DataFrame, ends: list[dt.date]) -> DataFrame:
        """A running sum over each party's periods, repeated for the ends at
        which it didn't move.  A party has one row a period here, so no
        party is large."""
        upto = Window.partitionBy(*KEYS).orderBy("period_end")
        until = F.coalesce(F.lead("period_end").over(upto), F.date_add(F.lit(ends[-1]), 1))
        known = F.array(*[F.lit(e) for e in ends])
        summed = moved.select(
            *KEYS, F.sum("debit").over(upto).cast(SUM).alias("debit"), F.sum("credit").over(upto).cast(SUM).alias("credit"),
            F.min("first_posting_date").over(upto).alias("first_posting_date"),
            F.col("period_end").alias("_from"), until.alias("_until"))
        at = F.filter(known, lambda e: (e >= F.col("_from")) & (e < F.col("_until")))
        return summed.withColumn("period_end", F.explode(at)).drop("_from", "_until")

    def _store(self, df: DataFrame, name: str, schema: StructType) -> None:
        """Replace the partitions that ``df`` has rows of."""
        (df.select(*schema.names).repartitionByRange("period_end", *[c for c in ("party", "file") if c in schema.names])
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period_end")
         .parquet(f"{self.path}/{name}"))
