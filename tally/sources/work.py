"""The folder in which stored intermediate tables go.

It is the one the cluster names in ``spark.checkpoint.dir``, which every
executor sees.  Only a session on one machine (``local[...]``) that has none
gets a temporary folder; on a cluster the setting is required.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tally-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` run once and read back from its reliable checkpoint."""
    work_dir(df.sparkSession)
    return df.checkpoint(eager=True)
