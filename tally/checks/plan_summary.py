"""One line per registered query describing its physical plan (before AQE):
shuffles, broadcasts, join kinds, aggregates, scans and pushed filters.

``python -m tally.checks.plan_summary [sf_dir] [--no-broadcast] [--erp=DIR]``.
``--no-broadcast`` sets both broadcast thresholds to -1, which shows the
shuffle structure a cluster gets when no side fits under the threshold.
``--erp=DIR`` reads the ERP tables as parquet folders under DIR (as written
by ``sources.layout``) instead of deriving them, so the counts are those of
the report logic alone.
"""

from __future__ import annotations

import contextlib
import io
import re
import sys

COUNTED = {
    "shuffle": r"^\(\d+\) Exchange$",
    "broadcast": r"^\(\d+\) BroadcastExchange$",
    "smj": r"^\(\d+\) SortMergeJoin",
    "bhj": r"^\(\d+\) BroadcastHashJoin",
    "hash_agg": r"^\(\d+\) HashAggregate",
    "sort_agg": r"^\(\d+\) SortAggregate",
    "generate": r"^\(\d+\) Generate",
    "scans": r"^\(\d+\) Scan parquet",
}


def summarise(df) -> dict:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    text = buf.getvalue()
    lines = text.splitlines()
    out = {k: sum(1 for ln in lines if re.match(p, ln.strip())) for k, p in COUNTED.items()}
    out["pushed"] = sum(1 for ln in lines if ln.startswith("PushedFilters") and "IsNotNull" in ln
                        and re.search(r"(EqualTo|LessThan|GreaterThan|In\(|Not\()", ln))
    out["python"] = any(w in text for w in ("PythonUDF", "EvalPython", "InPandas"))
    out["cartesian"] = any(w in text for w in ("CartesianProduct", "BroadcastNestedLoopJoin"))
    return out


def main(argv: list[str]) -> None:
    from tally.plans.queries import QUERIES, STORING
    from tally.session import local_session

    args = [a for a in argv[1:] if not a.startswith("--")]
    sf_dir = args[0] if args else "/root/testdata/sf0.1"
    spark = local_session()
    erp = [a.split("=", 1)[1] for a in argv if a.startswith("--erp=")]
    tables = None
    if erp:
        from tally.sources.tables import from_parquet
        tables = from_parquet(spark, erp[0])
    if "--no-broadcast" in argv:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    cols = [*COUNTED, "pushed", "python", "cartesian"]
    print("| query | " + " | ".join(cols) + " |")
    print("| --- |" + " --- |" * len(cols))
    for key, q in QUERIES.items():
        if key in STORING:  # stores tables before it has a plan
            continue
        s = summarise(q(spark, sf_dir, tables))
        print(f"| `{key}` | " + " | ".join(str(s[c]) for c in cols) + " |")


if __name__ == "__main__":
    main(sys.argv)
