"""Benchmark: every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs to completion through the ``noop`` sink (full execution, no
driver collection), after one warm-up run of the whole set.  Prints one
JSON line: {"metric", "value" (sum of per-query seconds), "unit", "queries",
"sf", ...}.

By default every query derives its ERP tables from the TPC-H-style parquet
in ``$BENCH_SF_DIR``.  With ``$BENCH_ERP_DIR`` (ERP tables stored as parquet
folders, e.g. by ``tally.sources.layout``) the queries read those instead,
which times the report logic alone.  Keys that store tables before they read
them (``queries.STORING``) or force what only large tables get (``FORCED``) are
left out unless ``$BENCH_QUERIES`` names them.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    reps = int(os.environ.get("BENCH_REPS", "3"))
    only = [k for k in os.environ.get("BENCH_QUERIES", "").split(",") if k]

    from tally.plans.queries import FORCED, QUERIES, STORING
    from tally.session import local_session

    spark = local_session(cores=cpus, shuffle_partitions=cpus)
    keys = only or [k for k in QUERIES if k not in STORING + FORCED]
    erp_dir = os.environ.get("BENCH_ERP_DIR")

    def run(key: str) -> float:
        from tally.sources.tables import from_parquet

        t0 = time.perf_counter()  # the sources are listed and analysed anew each time
        tables = from_parquet(spark, erp_dir) if erp_dir else None
        QUERIES[key](spark, sf_dir, tables).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    for k in keys:  # warm-up: JIT, file listing, codegen caches
        run(k)
    times = {k: round(statistics.median(run(k) for _ in range(reps)), 3) for k in keys}
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "sum_of_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "reps": reps,
        "stat": "median",
        "spark": spark.version,
        "tables": "stored ERP parquet" if erp_dir else "derived from the TPC-H-style parquet",
    }))
    spark.stop()


if __name__ == "__main__":
    main()
