"""Run registered queries against their DuckDB oracle, the way the driver
does: row count, column names and an order-insensitive value hash.

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import os
import sys
import time
from decimal import Decimal

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if isinstance(v, Decimal):
        return str(int(v)) if v == v.to_integral_value() else str(v)
    if isinstance(v, float):
        return repr(round(v, 6))
    if isinstance(v, (bytes, bytearray)):
        return v.hex()
    return str(v) if v is not None else "NULL"


def digest(columns: list[str], rows: list[tuple]) -> str:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16]


TYPE_NAMES = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN"}


def spark_types(df) -> dict:
    return {f.name: TYPE_NAMES.get(f.dataType.simpleString(), f.dataType.simpleString().upper())
            for f in df.schema.fields}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def compare(spark, sf_dir: str, names: list[str] | None = None) -> dict:
    import __spark_entry__ as entry
    qs, sql = entry.queries(), entry.oracle_sql()
    con = duck(sf_dir)
    report = {}
    for name in names or list(qs):
        t0 = time.time()
        df = qs[name](spark, sf_dir)
        cols = df.columns
        rows = [tuple(r) for r in df.collect()]
        t1 = time.time()
        res = {"rows": len(rows), "spark_s": round(t1 - t0, 2)}
        if name in sql:
            cur = con.execute(sql[name])
            ocols = [d[0] for d in cur.description]
            orows = cur.fetchall()
            otypes = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql[name]}").fetchall()}
            res.update(oracle_rows=len(orows), oracle_s=round(time.time() - t1, 2),
                       cols_match=sorted(cols) == sorted(ocols),
                       types_match=spark_types(df) == otypes,
                       hash_match=digest(cols, rows) == digest(ocols, orows))
            if not res["hash_match"]:
                order = sorted(range(len(cols)), key=lambda i: cols[i])
                oorder = sorted(range(len(ocols)), key=lambda i: ocols[i])
                a = {"|".join(_norm(r[i]) for i in order) for r in rows}
                b = {"|".join(_norm(r[i]) for i in oorder) for r in orows}
                res["only_spark"] = sorted(a - b)[:3]
                res["only_oracle"] = sorted(b - a)[:3]
        report[name] = res
        print(name, res, flush=True)
    return report


if __name__ == "__main__":
    from logweave.session import local_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = local_session(8, 8)
    rep = compare(spark, sf, names)
    bad = [n for n, r in rep.items() if not r.get("hash_match", True) or not r.get("cols_match", True)]
    print("MISMATCH:", bad)
