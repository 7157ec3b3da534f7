"""Compare the registered queries with their SQL oracles on the same tables.

Usage: python tools/check.py [--sf DIR] [--explain] [name ...]
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from spanledger.queries import ORACLES, QUERIES  # noqa: E402
from spanledger.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0 if v else 0.0)
    if isinstance(v, decimal.Decimal):
        return "dec:" + str(v)
    if isinstance(v, bool):
        return "b" + str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v].__repr__()
    return f"{type(v).__name__}:{v}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows), sorted(columns)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--explain", action="store_true")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark = local_session("8")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{args.sf}/{t}.parquet')")
    bad = 0
    for name in args.names or list(QUERIES):
        t0 = time.time()
        try:
            df = QUERIES[name](spark, args.sf)
            if args.explain:
                df.explain("formatted")
            got, cols = rows_of(df.columns, df.collect())
        except Exception as e:  # noqa: BLE001 - report and go on with the next query
            bad += 1
            print(f"ERROR {name}: {str(e)[:1500]}")
            continue
        took = time.time() - t0
        n = sum(got.values())
        if name not in ORACLES:
            print(f"rows  {name}: {n} rows {took:.2f}s")
            continue
        t0 = time.time()
        try:
            cur = con.execute(ORACLES[name])
            want, wcols = rows_of([d[0] for d in cur.description], cur.fetchall())
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ORACLE ERROR {name}: {str(e)[:1500]}")
            continue
        duck = time.time() - t0
        ok = got == want and cols == wcols
        bad += not ok
        flag = "ok   " if ok else "DIFF "
        print(f"{flag} {name}: {n} rows spark {took:.2f}s duckdb {duck:.2f}s" + ("  EMPTY" if n == 0 else ""))
        if not ok:
            print("   columns", cols, wcols, "rows", n, sum(want.values()))
            for label, a, b in (("only spark", got, want), ("only oracle", want, got)):
                for r, k in list((a - b).items())[:4]:
                    print("  ", label, k, str(r)[:400])
    spark.stop()
    print("failures:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
