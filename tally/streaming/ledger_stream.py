"""The customer ledger summary (R1) kept current over a stream of ledger
entries.

The reference computes its reports on request from the database.  When
ledger entries arrive as a stream instead (files landing in a folder, a
message topic), the same rules run as one Structured Streaming query:

* the entry filters (F1-F6) are stateless;
* the return-invoice flag (J2) and the customer names (J1) are
  stream-static left joins against the batch tables;
* the buckets are one streaming aggregate per customer name, whose state
  is one row per name, emitted in ``update`` mode.

The checkpoint location is always the caller's (a shared folder on a
cluster); nothing here picks a local path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tally.functions import zero
from tally.operators import filters as flt
from tally.operators import ledger as led
from tally.plans.params import LedgerParams
from tally.sources.schemas import SCHEMAS, conform
from tally.sources.tables import ErpTables


def read_entries(spark, path: str, fmt: str = "parquet", max_files_per_trigger: int | None = None) -> DataFrame:
    """A stream of ``gl_entry`` rows from files under ``path`` (fixed schema)."""
    reader = spark.readStream.format(fmt).schema(SCHEMAS["gl_entry"])
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return conform(reader.load(path), "gl_entry")


def running_balances(entries: DataFrame, t: ErpTables, p: LedgerParams) -> DataFrame:
    """Streaming R1: per customer name the five buckets of all entries seen
    so far (up to ``p.to_date``).  ``is_suppressed`` marks names the batch
    report would drop (all buckets zero); keep the latest row per name and
    drop those to get the batch report.

    An entry is classified when it arrives: a return invoice or mapping stored
    after its entry was handled does not change that entry's bucket or name.
    The result equals the batch report only where those tables precede their
    entries."""
    gl = flt.for_party_type(flt.posted(entries), p.party_type)
    gl = flt.for_company(flt.up_to(gl, "posting_date", p.to_date), p.company)
    gl = gl.select("posting_date", "party", "voucher_no", "debit", "credit", "is_opening")
    returns = flt.return_invoices(t.sales_invoice, p.from_date)
    classified = led.classify(gl, returns, p.from_date, p.party_type)
    if p.party_type == "Customer":
        mapping = flt.for_customer_name(t.customer_mapping, p.customer)
        named = led.with_customer_name(classified, mapping, "party")
        if p.customer is not None:
            named = named.where(F.col("customer_name").isNotNull())
    else:
        named = classified.withColumn("customer_name", F.col("party"))
    # names group binary, as in the batch report, whatever the tables' collation
    named = named.withColumn("customer_name", F.collate("customer_name", "UTF8_BINARY"))
    amt, bucket = F.col("amount"), F.col("bucket")

    def part(name: str, sign: int = 1):
        return F.sum(F.when(bucket == name, amt * sign).otherwise(zero()))

    summary = named.groupBy("customer_name").agg(
        part("opening").alias("opening_balance"),
        part("invoiced").alias("invoiced_amount"),
        part("return", -1).alias("return_amount"),
        part("paid", -1).alias("paid_amount"),
        F.sum(amt).alias("closing_balance"),
        F.min("posting_date").alias("first_posting_date"),
    )
    # Update mode emits a row whenever a name changes; a filter here would
    # leave a stale row in the sink when a balance returns to zero, so the
    # zero rule (F10) is a flag the consumer applies after its upsert.
    nonzero = F.lit(False)
    for c in ("opening_balance", "invoiced_amount", "paid_amount", "return_amount"):
        nonzero = nonzero | (F.col(c) != 0)
    summary = summary.withColumn("is_suppressed", ~nonzero)
    return led.money_to_double(summary, led.MONEY_COLS)


def start(balances: DataFrame, checkpoint_location: str, sink: str,
          query_name: str = "customer_balances", trigger_seconds: int | None = None,
          **options: str) -> StreamingQuery:
    """Start the running-balance query in ``update`` mode (``sink`` is a format
    name; ``memory`` keeps every row on the driver and is for tests)."""
    writer = (
        balances.writeStream.outputMode("update")
        .format(sink)
        .option("checkpointLocation", checkpoint_location)
        .queryName(query_name)
    )
    for k, v in options.items():
        writer = writer.option(k, v)
    if trigger_seconds:
        writer = writer.trigger(processingTime=f"{trigger_seconds} seconds")
    return writer.start()
