"""Compare registered queries with their DuckDB statements: python tests/oracle_check.py [sf] [name ...]"""
from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def compare(df, con, sql):
    """None when equal, else a short description."""
    cols = sorted(df.columns)
    got = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}", len(got)
    idx = [names.index(c) for c in cols]
    want = [tuple(norm(r[i]) for i in idx) for r in rel.fetchall()]
    key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
    got.sort(key=key), want.sort(key=key)
    if got == want:
        return None, len(got)
    sg, sw = set(got), set(want)
    return (f"rows {len(got)} vs {len(want)}; cols {cols}\n   only spark {sorted(sg - sw, key=key)[:3]}"
            f"\n   only duck {sorted(sw - sg, key=key)[:3]}; diff {len(sg - sw)}"), len(got)


def main(argv):
    from rallyframe.plans import all_queries, all_oracles
    from rallyframe.session import build_session
    sf = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("local[8]", spark__sql__shuffle__partitions="8")
    spark.sparkContext.setLogLevel("ERROR")
    con, qs, sqls = connect(sf_dir), all_queries(), all_oracles()
    names = [n for n in qs if not argv[1:] or any(p in n for p in argv[1:])]
    bad = 0
    for n in names:
        t = time.time()
        try:
            df = qs[n](spark, sf_dir)
            if n in sqls:
                msg, rows = compare(df, con, sqls[n])
            else:
                msg, rows = None, df.count()
            state = "ok " if msg is None else "BAD"
        except Exception as e:  # report and go on
            msg, rows, state = f"{type(e).__name__}: {str(e)[:600]}", 0, "ERR"
        bad += state != "ok "
        print(f"{state} {n:32s} rows={rows:<7d} {'oracle' if n in sqls else 'rows  '} {time.time() - t:.2f}s {msg or ''}", flush=True)
    print(f"{len(names)} queries, {bad} not ok")


if __name__ == "__main__":
    main(sys.argv[1:])
