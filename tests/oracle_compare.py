"""Run registered queries on Spark and their oracle SQL on DuckDB, compare.

Usage: python tests/oracle_compare.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import json
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet('{p}')")
    return con


def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return f"{round(v, 6):.6f}"
    if isinstance(v, decimal.Decimal):
        return f"{round(float(v), 6):.6f}"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, dict):
        return json.dumps({str(k): norm(x) for k, x in sorted(v.items())})
    if isinstance(v, (list, tuple)):
        return json.dumps([norm(x) for x in v])
    if hasattr(v, "asDict"):
        return json.dumps({k: norm(x) for k, x in v.asDict().items()})
    return str(v)


def family(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "int"
    if isinstance(v, (float, decimal.Decimal)):
        return "float"
    if isinstance(v, dt.datetime):
        return "ts"
    if isinstance(v, dt.date):
        return "date"
    return type(v).__name__


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows), [cols[i] for i in order]


_SPARK_TO_DUCK = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
    "timestamp": "TIMESTAMP WITH TIME ZONE",
    "boolean": "BOOLEAN",
}


def type_mismatches(sdf, con, sql):
    """Columns whose Spark type does not map to the oracle's DuckDB type."""
    duck_types = {r[0]: r[1] for r in con.execute(f"describe {sql}").fetchall()}
    out = []
    for name, t in sdf.dtypes:
        want = _SPARK_TO_DUCK.get(t, t.upper())
        got = duck_types.get(name)
        if got is not None and got != want:
            out.append(f"{name}: spark {t} vs duckdb {got}")
    return out


def compare(spark, name, fn, sql, sf_dir, con):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    scols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    ts = time.time() - t0
    if sql is None:
        return {"name": name, "ok": None, "rows": len(srows), "spark_s": round(ts, 2)}
    t1 = time.time()
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    td = time.time() - t1
    out = {"name": name, "rows": len(srows), "oracle_rows": len(drows), "spark_s": round(ts, 2), "duck_s": round(td, 2)}
    if sorted(scols) != sorted(dcols):
        out.update(ok=False, why=f"columns {sorted(scols)} vs {sorted(dcols)}")
        return out
    a, _ = rows_of(scols, srows)
    b, _ = rows_of(dcols, drows)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        out.update(ok=False, why=f"values differ, e.g. {diff}")
        return out
    # type families per column (first non-null)
    for c in scols:
        i, j = scols.index(c), dcols.index(c)
        fs = next((family(r[i]) for r in srows if r[i] is not None), None)
        fd = next((family(r[j]) for r in drows if r[j] is not None), None)
        if fs and fd and fs != fd:
            out.update(ok=False, why=f"type {c}: {fs} vs {fd}")
            return out
    tm = type_mismatches(sdf, con, sql)
    if tm:
        out.update(ok=False, why=f"types: {tm}")
        return out
    out["ok"] = True
    return out


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    pats = [a for a in argv[1:] if not a.startswith("/")]
    from wardstat import get_spark
    import __spark_entry__ as E

    spark = get_spark("local[8]", shuffle_partitions=8, driver_memory="8g")
    qs, orc = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in sorted(qs):
        if pats and not any(p in name for p in pats):
            continue
        try:
            r = compare(spark, name, qs[name], orc.get(name), sf_dir, con)
        except Exception as e:  # report and continue
            r = {"name": name, "ok": False, "why": f"{type(e).__name__}: {str(e)[:300]}"}
        if r.get("ok") is False:
            bad += 1
        print(json.dumps(r), flush=True)
    print(f"# failures: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
