"""Run queries in Spark and their SQL in DuckDB and compare: python -m checks.compare [-d DIR] [name ...]"""

from __future__ import annotations

import argparse
import math
import time

import duckdb

from tableprep.session import local_session

from . import ORACLES, QUERIES
from .registry import NAMES


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return v if v else 0.0
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def connect(folder: str):
    con = duckdb.connect()
    for n in NAMES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{folder}/{n}.parquet')")
    return con


def main() -> None:
    p = argparse.ArgumentParser()
    p.add_argument("-d", "--dir", default="/root/testdata/sf0.01")
    p.add_argument("names", nargs="*")
    args = p.parse_args()
    spark = local_session("8")
    con = connect(args.dir)
    bad, total = [], 0.0
    for name in args.names or QUERIES:
        start = time.time()
        try:
            df = QUERIES[name](spark, args.dir)
            got = rows_of(df.columns, df.collect())
            took = time.time() - start
            total += took
            if name not in ORACLES:
                print(f"{name:28s} rows {len(got[1])} {took:.2f}s (no SQL)", flush=True)
                continue
            start = time.time()
            res = con.execute(ORACLES[name])
            want = rows_of([c[0] for c in res.description], res.fetchall())
            duck = time.time() - start
        except Exception as e:
            bad.append(name)
            con = connect(args.dir)
            print(f"{name:28s} ERROR {type(e).__name__}: {str(e)[:600]}", flush=True)
            continue
        if got == want:
            print(f"{name:28s} ok rows {len(got[1])} {took:.2f}s duck {duck:.2f}s", flush=True)
            continue
        bad.append(name)
        print(f"{name:28s} DIFFERS rows {len(got[1])} / {len(want[1])} columns {got[0]} / {want[0]}")
        a, b = set(map(repr, got[1])), set(map(repr, want[1]))
        print("   only spark:", sorted(a - b)[:3], len(a - b))
        print("   only sql:  ", sorted(b - a)[:3], len(b - a), flush=True)
    print(f"{total:.1f}s; not equal: {bad}")


if __name__ == "__main__":
    main()
