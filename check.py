"""Compare registered queries with their SQL twins: python check.py [sf_dir] [name ...]."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from allotment.session import local_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and v != v) or v is pd.NaT:
        return "~"
    if hasattr(v, "__len__") and not isinstance(v, str):
        return str([cell(x) for x in v])
    if isinstance(v, float) or type(v).__name__ == "float64":
        return repr(float(v))
    if isinstance(v, bool) or type(v).__name__ in ("bool", "bool_"):
        return str(bool(v))
    return str(v)


def canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(df, sql: str, con) -> str:
    left = canon([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(sql)
    right = canon(cur.fetchall(), [d[0] for d in cur.description])
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if left[1] == right[1]:
        return "ok"
    only_l, only_r = list(set(left[1]) - set(right[1])), list(set(right[1]) - set(left[1]))
    return f"rows {len(left[1])} vs {len(right[1])}; {len(only_l)} differ, e.g. {sorted(only_l)[:2]} vs {sorted(only_r)[:2]}"


def main() -> int:
    from allotment.catalog import ORACLES, QUERIES
    args = sys.argv[1:]
    folder = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark, con, bad = local_session(8), duck(folder), 0
    for name in args or QUERIES:
        start = time.time()
        try:
            df = QUERIES[name](spark, folder)
            if name in ORACLES:
                verdict = compare(df, ORACLES[name], con)
            else:
                verdict = f"rows-only {df.count()}"
        except Exception as error:  # report and go on with the rest
            verdict = "ERROR " + str(error)[:1500]
        bad += not (verdict == "ok" or verdict.startswith("rows-only"))
        print(f"{name:40s} {time.time() - start:6.1f}s {verdict}", flush=True)
    print("failing:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
