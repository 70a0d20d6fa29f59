"""Run registered queries beside their SQL twins in DuckDB and compare whole results.

    python tests/oracle.py [-d SF_DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted([tuple(_norm(r[i]) for i in order) for r in rows], key=repr)


def compare(spark, con, sf_dir, name, query, sql):
    """None when equal, else a message."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = rows_of(cols, cur.fetchall())
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(df.columns)} != {sorted(cols)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; first {got[:1]} / {want[:1]}"
    if got != want:
        diff = [(g, w) for g, w in zip(got, want) if g != w]
        return f"{len(diff)} of {len(got)} rows differ ({sorted(cols)}): {diff[:3]}"
    if not got:
        return "empty on both sides"
    return None


def main():
    import __spark_entry__ as entry
    from breaklens.session import local_session

    ap = argparse.ArgumentParser()
    ap.add_argument("-d", default="/root/testdata/sf0.01")
    ap.add_argument("-m", help="only queries from this plans module")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.d)
    queries, oracle = entry.queries(), entry.oracle_sql()
    names = args.names or [n for n in queries if not args.m or queries[n].__module__.endswith(args.m)]
    bad = 0
    for n in names:
        t = time.time()
        try:
            msg = compare(spark, con, args.d, n, queries[n], oracle.get(n))
        except Exception as e:  # noqa: BLE001 - report and go on
            msg = f"{type(e).__name__}: {str(e)[:1500]}"
        kind = "sql " if n in oracle else "rows"
        print(f"{'ok  ' if msg is None else 'FAIL'} {kind} {time.time() - t:6.1f}s {n} {msg or ''}", flush=True)
        bad += msg is not None
    print(f"{len(names) - bad}/{len(names)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
