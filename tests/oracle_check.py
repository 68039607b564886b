"""Run queries() against oracle_sql() on DuckDB, the way the driver does.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def canon(df: pd.DataFrame):
    cols = sorted(df.columns)
    rows = [tuple(_norm(v) for v in r) for r in df[cols].itertuples(index=False, name=None)]
    rows.sort(key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))
    return cols, rows


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    a = sdf.toPandas()
    t1 = time.time()
    b = con.execute(sql).df()
    ca, ra = canon(a)
    cb, rb = canon(b)
    ok = ca == cb and len(ra) == len(rb) and ra == rb
    msg = ""
    if not ok:
        if ca != cb:
            msg = f"cols {ca} vs {cb}"
        elif len(ra) != len(rb):
            msg = f"rows {len(ra)} vs {len(rb)}"
        else:
            bad = [(x, y) for x, y in zip(ra, rb) if x != y]
            msg = f"{len(bad)} value mismatches, e.g. {bad[:2]}"
    return ok, len(ra), t1 - t0, msg


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from clickfeat.session import build_session
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for n, fn in qs.items():
        if names and n not in names:
            continue
        if n not in sqls:
            df = fn(spark, sf_dir)
            print(f"{n:32s} rows-only {df.count()}")
            continue
        try:
            ok, nrows, dt, msg = compare(spark, con, n, fn, sqls[n], sf_dir)
        except Exception as e:  # noqa: BLE001
            ok, nrows, dt, msg = False, -1, 0, f"ERROR {type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print(f"{n:32s} {'OK ' if ok else 'BAD'} rows={nrows} {dt:.1f}s {msg}", flush=True)
    print("mismatches:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
