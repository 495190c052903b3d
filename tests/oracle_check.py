"""Run queries() against oracle_sql() in DuckDB: python tests/oracle_check.py [sf] [name…]."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    import numpy as np

    if isinstance(v, np.generic):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(frame_rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in frame_rows]
    return sorted(out, key=lambda r: tuple((x is not None, str(type(x)), str(x)) for x in r)), [columns[i] for i in order]


def compare(spark_df, con, sql: str) -> str:
    got = spark_df.collect()
    a, ca = rows_of([tuple(r) for r in got], spark_df.columns)
    rel = con.execute(sql)
    cb = [d[0] for d in rel.description]
    b, cb = rows_of(rel.fetchall(), cb)
    if ca != cb:
        return f"columns differ: {ca} / {cb}"
    if len(a) != len(b):
        return f"rows differ: {len(a)} / {len(b)}\n   {a[:2]}\n   {b[:2]}"
    for x, y in zip(a, b):
        if x != y:
            return f"values differ:\n   {x}\n   {y}"
        for p, q in zip(x, y):
            if type(p) is not type(q):
                return f"types differ: {type(p)} / {type(q)} in {ca}"
    return f"ok ({len(a)} rows)"


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from tilewright.session import local_session

    args = sys.argv[1:]
    sf = args[0] if args and args[0].replace(".", "").isdigit() else "0.01"
    names = [a for a in args if a != sf]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(8), duck(sf_dir)
    q, o = queries(), oracle_sql()
    bad = 0
    for name, fn in q.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        t = time.time()
        try:
            if name in o:
                res = compare(fn(spark, sf_dir), con, o[name])
            else:
                res = f"rows only ({fn(spark, sf_dir).count()} rows)"
        except Exception as exc:
            res = f"FAILED {type(exc).__name__}: {str(exc)[:1500]}"
        good = res.startswith(("ok", "rows only"))
        bad += not good
        print(f"{'    ' if good else '!!! '}{name}: {res}  [{time.time() - t:.1f}s]", flush=True)
    print(f"{bad} failing; unmatched oracle keys: {sorted(set(o) - set(q))}")
    return bad


if __name__ == "__main__":
    sys.exit(main())
