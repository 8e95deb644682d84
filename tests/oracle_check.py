"""Compare registered queries with their SQL statements in DuckDB.

    python tests/oracle_check.py sf0.001 [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

import __spark_entry__ as entry_module

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, folder: str) -> tuple[str, float, float]:
    fn, sql = entry_module.queries()[name], entry_module.oracle_sql().get(name)
    t0 = time.time()
    df = fn(spark, folder)
    got = df.collect()
    t1 = time.time()
    if sql is None:
        return f"rows-only {len(got)}", t1 - t0, 0.0
    cur = con.execute(sql)
    want = cur.fetchall()
    t2 = time.time()
    names = [d[0] for d in cur.description]
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a[0] != b[0]:
        return f"COLUMNS differ: spark {a[0]} sql {b[0]}", t1 - t0, t2 - t1
    if a[1] != b[1]:
        only_a = sorted(set(a[1]) - set(b[1]))[:2]
        only_b = sorted(set(b[1]) - set(a[1]))[:2]
        return f"ROWS differ: {len(a[1])} vs {len(b[1])}\n   spark: {str(only_a)[:900]}\n   sql:   {str(only_b)[:900]}", t1 - t0, t2 - t1
    return f"ok {len(got)}", t1 - t0, t2 - t1


def main(argv):
    from whylake.session import build_session

    folder = f"/root/testdata/{argv[0]}"
    spark = build_session("local[8]")
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    names = argv[1:] or list(entry_module.queries())
    bad = 0
    for name in names:
        try:
            status, a, b = compare(spark, con, name, folder)
        except Exception as exc:  # noqa: BLE001 - a report, not a library
            status, a, b = f"ERROR {type(exc).__name__}: {str(exc)[:300]}", 0, 0
        flag = "" if status.startswith(("ok", "rows-only")) else "  <<<<<<"
        bad += bool(flag)
        print(f"{name:22s} spark {a:6.2f}s sql {b:6.2f}s  {status}{flag}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
