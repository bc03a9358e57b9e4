"""R1 from a stream of changes, right also when a return invoice comes late.

``ledger_stream`` gives an entry its bucket when it arrives; a return invoice
that is stored after its entry does not move it.  Here the bucket itself is
streamed as a change, and a change can be taken back:

* entries whose bucket hangs on nothing else (opening, invoiced, no voucher) become
  one change each, without state;
* the others are kept by voucher: whether a return of that name has come, and the
  sum per party of what was booked as paid.  When the return comes, that sum goes
  back from paid and is booked as return; entries after it are returns at once.

Changes ``(party, posting_date, bucket, amount)`` are only ever appended, so any
file sink with a checkpoint holds them exactly once, and R1 is their sum
(:func:`status_from_changes`).  Customer names are looked up then, on one row a party, so a
mapping may change too.  The state grows with the vouchers of payments in the
period, a few values each; it lives in the checkpoint the caller names.

A return invoice counts from its first submitted row on; its later
cancellation is not streamed (rebuild from the ledger then).
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import DecimalType

from tally.functions import zero
from tally.operators import filters as flt
from tally.operators import ledger as led
from tally.plans.params import LedgerParams
from tally.plans.reports import ledger_rows, of_customer
from tally.sources.schemas import SCHEMAS, conform
from tally.sources.tables import ErpTables

AMOUNT = DecimalType(31, 9)
CHANGE = "party string, posting_date date, bucket string, amount decimal(31,9)"
STATE = "returned boolean, parties array<string>, sums array<string>"
COLUMNS = ["party", "posting_date", "bucket", "amount"]


def read_invoices(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A stream of ``sales_invoice`` rows from parquet files under ``path``."""
    reader = spark.readStream.format("parquet").schema(SCHEMAS["sales_invoice"])
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return conform(reader.load(path), "sales_invoice")


def rebucket(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The changes of one voucher: rows with ``party`` are entries, one without is its return."""
    was, parties, sums = state.get if state.exists else (False, [], [])
    paid = {p: Decimal(s) for p, s in zip(parties, sums, strict=True)}
    rows = [r for part in parts for r in part[["party", "posting_date", "amount"]].itertuples(index=False)]
    returned = was or any(r.party is None for r in rows)
    out = []
    if returned and not was:
        for party, amount in paid.items():
            out += [(party, None, "paid", -amount), (party, None, "return", amount)]
        paid = {}
    for r in rows:
        if r.party is None:
            continue
        out.append((r.party, r.posting_date, "return" if returned else "paid", r.amount))
        if not returned:
            paid[r.party] = paid.get(r.party, Decimal(0)) + r.amount
    state.update((returned, list(paid), [str(x) for x in paid.values()]))
    yield pd.DataFrame(out, columns=COLUMNS)


def ledger_changes(entries: DataFrame, invoices: DataFrame, p: LedgerParams) -> DataFrame:
    """The stream of changes of a stream of ledger entries and one of invoices."""
    gl = flt.for_party_type(flt.posted(entries), p.party_type)
    gl = flt.for_company(flt.up_to(gl, "posting_date", p.to_date), p.company)
    gl = gl.withColumn("amount", led.signed_amount(p.party_type).cast(AMOUNT))
    opening = led.is_opening(p.from_date)
    asks = ~opening & (F.col("amount") <= 0) & F.col("voucher_no").isNotNull()
    bucket = F.when(opening, "opening").when(F.col("amount") > 0, "invoiced").otherwise("paid")
    settled = gl.where(~asks).select("party", "posting_date", bucket.alias("bucket"), "amount")
    booked = gl.where(asks).select("voucher_no", "party", "posting_date", "amount")
    returns = flt.return_invoices(invoices, p.from_date).select(
        F.col("name").alias("voucher_no"), F.lit(None).cast("string").alias("party"),
        F.lit(None).cast("date").alias("posting_date"), F.lit(None).cast(AMOUNT).alias("amount"))
    moved = booked.unionByName(returns).groupBy("voucher_no").applyInPandasWithState(
        rebucket, CHANGE, STATE, "append", GroupStateTimeout.NoTimeout)
    return settled.unionByName(moved)


def start_changes(changes: DataFrame, path: str, checkpoint_location: str, available_now: bool = False) -> StreamingQuery:
    """Append the changes to parquet files under ``path``."""
    writer = (changes.writeStream.outputMode("append").format("parquet").option("path", path)
              .option("checkpointLocation", checkpoint_location))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def status_from_changes(changes: DataFrame, t: ErpTables, p: LedgerParams, with_total: bool = False) -> DataFrame:
    """R1 from the changes stored so far."""
    def part(name: str, sign: int = 1):
        return F.sum(F.when(F.col("bucket") == name, F.col("amount") * sign).otherwise(zero()))

    per_party = changes.groupBy("party").agg(
        part("opening").alias("opening_balance"), part("invoiced").alias("invoiced_amount"),
        part("return", -1).alias("return_amount"), part("paid", -1).alias("paid_amount"),
        F.sum("amount").alias("closing_balance"), F.min("posting_date").alias("first_posting_date"))
    mapping = flt.for_customer_name(t.customer_mapping, p.customer) if p.party_type == "Customer" else None
    rows = ledger_rows(led.by_name(of_customer(per_party, t, p), mapping), t, p, with_total=with_total)
    return rows.drop("first_posting_date")
