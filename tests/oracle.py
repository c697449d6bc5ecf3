"""Runs a named query in Spark and its SQL in DuckDB and compares the rows.

    python tests/oracle.py [--sf sf0.01] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(0.0 if v == 0 else v)
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, int):
        return repr(v)
    if type(v).__name__ == "Decimal":
        return repr(float(v))
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    """None when equal, else a short description."""
    start = time.time()
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    compare.spark_seconds = time.time() - start
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    want = rows_of(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(cols)}"
    if got == want:
        return None if got else "equal but empty"
    extra = [r for r in got if r not in set(want)][:3]
    miss = [r for r in want if r not in set(got)][:3]
    return f"rows {len(got)} vs {len(want)}\n   spark only: {extra}\n   sql only:   {miss}"


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = "sf0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    import __spark_entry__ as entry
    from korvane.session import local_session
    spark = local_session(8)
    sf_dir = f"/root/testdata/{sf}"
    con = duck(sf_dir)
    fns, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args or fns:
        t = time.time()
        try:
            res = compare(spark, con, name, fns[name], sqls.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001 - report and go on
            res = f"{type(e).__name__}: {str(e)[:1200]}"
        bad += res is not None
        kind = "" if name in sqls else " (rows only)"
        print(f"{'ok  ' if res is None else 'FAIL'} {name}{kind} {time.time() - t:.1f}s "
              f"(spark {getattr(compare, 'spark_seconds', 0):.1f})",
              "" if res is None else "\n   " + res, flush=True)
    print(f"{bad} bad")
