"""The set of ERP tables a report reads, and ways to load it.

A report takes an :class:`ErpTables` and returns a lazy DataFrame.  Tables can
come from parquet folders, from the catalog, or from frames the caller made;
every one is conformed to its fixed schema (``schemas.SCHEMAS``) on first
use.  Tables are built on first access only, so a report that reads two
tables never lists, reads footers of or analyses the other nine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tally.sources.schemas import SCHEMAS, conform

TABLES: tuple[str, ...] = (
    "gl_entry",
    "customer_mapping",
    "sales_invoice",
    "sales_order",
    "sales_order_item",
    "sales_invoice_item",
    "item_variant_attribute",
    "delivery_note",
    "delivery_note_item",
    "company",
    "party_adjustment",
)

Source = DataFrame | Callable[[], DataFrame]


class ErpTables:
    """Named ERP tables; each value is a DataFrame or a zero-argument
    function building one.  Attribute access returns the conformed frame
    (built once).  ``party_adjustment`` may be absent (the reference stubs
    it as empty): then it reads as ``None``.

    ``collation`` (default binary) is applied to the text keys the reference
    compares in SQL; see ``schemas.TEXT_KEYS``."""

    def __init__(self, sources: dict[str, Source], collation: str | None = None):
        unknown = set(sources) - set(TABLES)
        if unknown:
            raise ValueError(f"unknown tables {sorted(unknown)}")
        missing = [t for t in TABLES if t != "party_adjustment" and t not in sources]
        if missing:
            raise ValueError(f"tables {missing} are required")
        self._sources = dict(sources)
        self._built: dict[str, DataFrame] = {}
        self.collation = collation

    def __getattr__(self, name: str) -> DataFrame | None:
        if name.startswith("_") or name not in TABLES:
            raise AttributeError(name)
        if name not in self._built:
            src = self._sources.get(name)
            if src is None:
                return None
            df = src if isinstance(src, DataFrame) else src()
            self._built[name] = conform(df, name, self.collation)
        return self._built[name]

    def replace(self, **sources: Source) -> ErpTables:
        return ErpTables({**self._sources, **sources}, self.collation)

    def with_collation(self, collation: str | None) -> ErpTables:
        """The same tables with text keys compared under ``collation``."""
        return ErpTables(self._sources, collation)


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[table])


def from_frames(spark: SparkSession, **frames: Source) -> ErpTables:
    """Caller-made frames (or builders of them)."""
    return ErpTables(frames)


def from_parquet(spark: SparkSession, root: str) -> ErpTables:
    """One parquet folder (or file) per table under ``root``."""
    base = root.rstrip("/")

    def reader(name: str) -> Callable[[], DataFrame]:
        def read() -> DataFrame:
            try:
                return spark.read.parquet(f"{base}/{name}")
            except AnalysisException as e:  # only the optional table may be absent; any other fault raises
                if name != "party_adjustment" or e.getCondition() != "PATH_NOT_FOUND":
                    raise
                return empty(spark, name)
        return read

    return ErpTables({name: reader(name) for name in TABLES})


def from_catalog(spark: SparkSession, database: str | None = None) -> ErpTables:
    """Tables registered in the catalog (e.g. bucketed managed tables)."""
    prefix = f"{database}." if database else ""

    def reader(name: str) -> Callable[[], DataFrame]:
        return lambda: spark.table(f"{prefix}{name}")

    names = [n for n in TABLES if n != "party_adjustment" or spark.catalog.tableExists(f"{prefix}{n}")]
    return ErpTables({name: reader(name) for name in names})
