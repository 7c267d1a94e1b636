"""Compare registered queries with their DuckDB statements: `python tests/oracle.py [sf] [name ...]`."""

from __future__ import annotations

import math
import sys
import time
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        return str(v.normalize() + 0)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return "∅" if v is None else str(v)


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(con, sql, df):
    rows = df.collect()
    res = con.execute(sql)
    got = canon(df.columns, [tuple(r) for r in rows])
    want = canon([d[0] for d in res.description], res.fetchall())
    return got, want


if __name__ == "__main__":
    from pricewatch.session import local_session

    import __spark_entry__ as e

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    names = sys.argv[2:]
    folder = f"/root/testdata/{sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name, fn in e.queries().items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            sql = e.oracle_sql().get(name)
            if sql is None:
                print(f"rows {name}: {fn(spark, folder).count()} ({time.time() - t0:.1f}s)", flush=True)
                continue
            got, want = compare(con, sql, fn(spark, folder))
            ok = got == want
            bad += not ok
            print(f"{'ok  ' if ok else 'DIFF'} {name}: {len(got[1])} rows ({time.time() - t0:.1f}s)", flush=True)
            if not ok:
                print("   columns", got[0], want[0], len(want[1]))
                g, w = set(got[1]), set(want[1])
                print("   only spark", sorted(g - w)[:3], "\n   only duckdb", sorted(w - g)[:3], flush=True)
        except Exception as err:  # noqa: BLE001
            bad += 1
            print(f"ERR  {name}: {str(err)[:700]}", flush=True)
    print("bad:", bad)
