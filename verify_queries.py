"""Compare registered queries with their SQL checks on DuckDB.

    python verify_queries.py [--sf 0.01] [name-part ...]
"""

from __future__ import annotations

import argparse
import sys
import time
import traceback

import duckdb

from folioscope.plans.registry import catalog
from folioscope.plans.tables import BASE
from folioscope.session import build_session


def canonical(value) -> str:
    if value is None:
        return "∅"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--data", default="/root/testdata")
    args = parser.parse_args()
    root = f"{args.data}/sf{args.sf}"
    spark = build_session("local[8]", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="12g", spark__sql__shuffle__partitions="8")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    bad = 0
    for name, q in catalog().items():
        if args.names and not any(p in name for p in args.names):
            continue
        start = time.time()
        try:
            df = q(spark, root)
            columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
            took = time.time() - start
            if q.oracle is None:
                print(f"rows  {name}: {len(got)} rows {took:.1f}s", flush=True)
                continue
            rel = con.execute(q.oracle)
            wanted_columns, want = rows_of([d[0] for d in rel.description], rel.fetchall())
            ok = columns == wanted_columns and got == want
            types = {f.name: f.dataType.simpleString() for f in df.schema}
            print(f"{'ok   ' if ok else 'DIFF '} {name}: {len(got)} rows, {len(want)} wanted {took:.1f}s", flush=True)
            if not ok:
                bad += 1
                print("   columns", columns, wanted_columns, types)
                extra, lost = sorted(set(got) - set(want))[:4], sorted(set(want) - set(got))[:4]
                for row in extra:
                    print("   spark ", str(row)[:400])
                for row in lost:
                    print("   duckdb", str(row)[:400])
        except Exception as exc:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: {type(exc).__name__}: {str(exc)[:900]}", flush=True)
            if not isinstance(exc, (duckdb.Error,)):
                print("      " + "".join(traceback.format_tb(exc.__traceback__)[-2:])[-700:].replace("\n", "\n      "))
    print("differences:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
