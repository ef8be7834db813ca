"""Compare registered queries with their SQL in DuckDB.

    python tests/check.py [folder] [name or prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd

from tidewatch.plans import catalog
from tidewatch.plans.registry import TABLES


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def norm(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if hasattr(v, "item"):
        return norm(v.item())
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def kinds(rows):
    found = [set() for _ in (rows[0] if rows else ())]
    for r in rows:
        for i, v in enumerate(r):
            if v is not None:
                found[i].add(type(v).__name__)
    return found


def compare(spark, con, folder: str, name: str) -> tuple[bool, str]:
    q = catalog.REGISTRY[name]
    df = catalog.run(name, spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if q.sql is None:
        return True, f"rows only {len(got)}"
    cur = con.execute(q.sql)
    want_cols = [d[0] for d in cur.description]
    want = rows_of(want_cols, cur.fetchall())
    if sorted(df.columns) != sorted(want_cols):
        return False, f"columns {sorted(df.columns)} != {sorted(want_cols)}"
    if kinds(got) != kinds(want):
        return False, f"types {list(zip(sorted(df.columns), kinds(got), kinds(want)))}"
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w][:3]
        return False, f"rows {len(got)} vs {len(want)}; columns {sorted(df.columns)}; first: {bad}"
    return True, f"{len(got)} rows"


def main(argv):
    from tidewatch.session import local_session

    folder = argv[0] if argv and argv[0].startswith("/") else "/root/testdata/sf0.001"
    wanted = [a for a in argv if not a.startswith("/")]
    names = [n for n in catalog.REGISTRY if not wanted or any(n == w or n.startswith(w + "*") or (w.endswith("*") and n.startswith(w[:-1])) for w in wanted)]
    spark = local_session("8")
    con = connect(folder)
    failed = []
    for name in names:
        t = time.time()
        try:
            ok, note = compare(spark, con, folder, name)
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {time.time() - t:6.2f}s {note}", flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(names) - len(failed)}/{len(names)} ok; failed: {failed}")


if __name__ == "__main__":
    main(sys.argv[1:])
