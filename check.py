"""Compare queries with their SQL twins: ``python check.py [sf] [key ...]`` (a trailing * is a prefix)."""

from __future__ import annotations

import importlib
import math
import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None:
        return ("", "null")
    if isinstance(v, bool):
        return ("n", float(v))
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        f = float(v)
        return ("", "nan") if math.isnan(f) else ("n", f + 0.0)
    return ("s", str(v))


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql, sf):
    df = fn(spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return f"rows {len(got)}", True
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}", False
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}", False
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, e.g. {sorted(names)}\n   spark {bad[0][0]}\n   sql   {bad[0][1]}", False
    return f"rows {len(got)} equal", True


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    from labelq.session import local_session

    entry = importlib.import_module("__spark_entry__")
    queries, oracles = entry.queries(), entry.oracle_sql()
    keys = [k for k in queries if not wanted or any(k == w or (w.endswith("*") and k.startswith(w[:-1])) for w in wanted)]
    spark = local_session("check", int(os.environ.get("BENCH_CPUS", "8")))
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    failed = []
    for k in keys:
        t0 = time.time()
        try:
            msg, ok = compare(spark, con, queries[k], oracles.get(k), sf_dir)
        except Exception as e:  # noqa: BLE001
            msg, ok = f"{type(e).__name__}: {str(e)[:900]}", False
        if not ok:
            failed.append(k)
        print(f"{'ok  ' if ok else 'FAIL'} {k:32s} {time.time()-t0:6.2f}s {msg}", flush=True)
    print(f"{len(keys) - len(failed)} of {len(keys)} good; failed: {failed}")
    spark.stop()
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
