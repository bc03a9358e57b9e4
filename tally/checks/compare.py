"""Two-engine comparison: a registered Spark query against its DuckDB oracle.

Both results go to pandas; columns are sorted by name, values normalised
(dates and decimals to text / float, floats rounded), rows sorted, then
compared.  Used by the tests and by ``python -m tally.checks.compare``.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb
import pandas as pd

TPCH = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TPCH:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 4)
    if isinstance(v, (dt.date, dt.datetime, pd.Timestamp)):
        return str(v)[:10]
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _exact(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (dt.datetime, pd.Timestamp)):
        return str(v)
    if hasattr(v, "item"):
        return _exact(v.item())
    return v


def normalise(rows: list[dict], exact: bool = False) -> list[tuple]:
    f = _exact if exact else _norm
    out = [tuple((k, f(r[k])) for k in sorted(r)) for r in rows]
    return sorted(out, key=repr)


def _family(type_name: str) -> str:
    t = type_name.lower()
    for fam, keys in (("int", ("int", "long", "short", "byte")), ("float", ("double", "float", "real")),
                      ("decimal", ("decimal",)), ("date", ("date",)), ("timestamp", ("timestamp",)),
                      ("string", ("string", "varchar", "char")), ("bool", ("bool",))):
        if any(k in t for k in keys):
            return fam
    return t


def compare(spark, key: str, sf_dir: str, con=None) -> dict:
    from tally.checks.oracle_sql import ORACLE_SQL
    from tally.plans.queries import QUERIES

    con = con or duck(sf_dir)
    t0 = time.time()
    sdf = QUERIES[key](spark, sf_dir)
    s_rows = [r.asDict() for r in sdf.collect()]
    t1 = time.time()
    rel = con.sql(ORACLE_SQL[key])
    d_cols = rel.columns
    d_types = {c: _family(str(t)) for c, t in zip(d_cols, rel.types)}
    s_types = {f.name: _family(f.dataType.simpleString()) for f in sdf.schema.fields}
    d_rows = [dict(zip(d_cols, r)) for r in rel.fetchall()]
    t2 = time.time()
    res = {
        "key": key,
        "spark_rows": len(s_rows),
        "oracle_rows": len(d_rows),
        "columns_match": sorted(sdf.columns) == sorted(d_cols),
        "spark_sec": round(t1 - t0, 2),
        "oracle_sec": round(t2 - t1, 2),
    }
    res["values_match"] = res["columns_match"] and normalise(s_rows) == normalise(d_rows)
    res["exact_match"] = res["columns_match"] and normalise(s_rows, True) == normalise(d_rows, True)
    res["types_match"] = s_types == d_types
    if not res["types_match"]:
        res["type_diff"] = {c: (s_types.get(c), d_types.get(c)) for c in set(s_types) | set(d_types)
                            if s_types.get(c) != d_types.get(c)}
    if not res["columns_match"]:
        res["spark_cols"], res["oracle_cols"] = sdf.columns, d_cols
    return res


def main(argv: list[str]) -> int:
    from tally.plans.queries import QUERIES
    from tally.session import local_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:] or list(QUERIES)
    spark = local_session()
    con = duck(sf_dir)
    bad = 0
    for k in keys:
        try:
            r = compare(spark, k, sf_dir, con)
        except Exception as e:  # noqa: BLE001
            r = {"key": k, "error": repr(e)[:500]}
        ok = (r.get("values_match") and r.get("exact_match") and r.get("types_match")
              and r.get("spark_rows") == r.get("oracle_rows"))
        bad += not ok
        print(("OK  " if ok else "FAIL"), r, flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
