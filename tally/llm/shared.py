"""Small helpers the training-data operators share.

Definitions every operator keeps to:

* a *word* is a run of characters other than space and \\x09-\\x0D;
* a null text is an empty text;
* column names the operators add internally never clash with input columns
  (:func:`fresh`).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.sources.work import work_dir

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]*"


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null.

    A word put in front makes words and the gaps behind them cover the whole text, so that each may become one
    letter; ``regexp_count`` would build a list of the words' copies for every text.
    """
    letters = F.regexp_replace(F.concat(F.lit("w "), text), WORD + GAP, "w")
    return F.coalesce(F.length(letters) - 1, F.lit(0)).cast("long")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names with as many leading underscores as no column of ``df`` has."""
    prefix = "_"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    return [prefix + n for n in names]


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session
    (only a ``local[...]`` session may go without: it gets a temporary one)."""
    return work_dir(spark)


def cut(df: DataFrame) -> DataFrame:
    """Run ``df`` once and go on from its reliable checkpoint (narrow frames)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Run ``df`` once into a Parquet table of the shared folder and read it back.

    For frames that carry texts: Parquet keeps them compressed, by zstd, which
    also packs digests and base64 that snappy leaves as they are.  The folder
    belongs to the cluster, which clears it as it does checkpoints.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
