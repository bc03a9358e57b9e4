"""SparkSession settings the library relies on.

Production jobs get their session from the cluster; :func:`tune` only sets
what the reports need (AQE with skew-join splitting, UTC, no UI) and leaves
everything the cluster already configured alone.  The reports are single
acyclic plans with no iteration, so no lineage is cut and no checkpoint
folder is needed.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Settings applied when the session does not already carry a value.
DEFAULTS: dict[str, str] = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply :data:`DEFAULTS` where the session has no value of its own."""
    for key, value in DEFAULTS.items():
        if spark.conf.get(key, None) in (None, ""):
            spark.conf.set(key, value)
    # AQE must stay on: runtime broadcast decisions and skew splitting
    # are how the joins below stay safe at any data size.
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def local_session(cores: int | None = None, shuffle_partitions: int | None = None,
                  app: str = "tally") -> SparkSession:
    """A local session for tests and the bench (UI off, AQE on)."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    parts = shuffle_partitions or cores
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.default.parallelism", str(parts))
        .config("spark.driver.memory", os.environ.get("TALLY_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)
