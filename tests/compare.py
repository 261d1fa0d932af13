"""Runs a query on Spark and its check SQL on DuckDB and compares all values."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(round(v, 6) + 0.0)
    return v if v is None else str(v)


def normal(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, name):
    from __spark_entry__ import oracle_sql, queries

    t0 = time.time()
    df = queries()[name](spark, sf_dir)
    got = normal(df.columns, df.collect())
    t1 = time.time()
    res = con.execute(oracle_sql()[name])
    cols = [d[0] for d in res.description]
    want = normal(cols, res.fetchall())
    t2 = time.time()
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}", t1 - t0, t2 - t1
    if got[1] == want[1]:
        return None, t1 - t0, t2 - t1
    a, b = set(got[1]), set(want[1])
    extra = [f"rows {len(got[1])} vs {len(want[1])}"]
    extra += [f"spark only: {str(r)[:600]}" for r in sorted(a - b, key=repr)[:3]]
    extra += [f"check only: {str(r)[:600]}" for r in sorted(b - a, key=repr)[:3]]
    return "\n   ".join(extra), t1 - t0, t2 - t1


def main(argv):
    from shelfwise.session import build_session
    from __spark_entry__ import oracle_sql, queries

    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="12g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(argv[0]), 0
    for name in argv[1:] or list(queries()):
        if name not in oracle_sql():
            print(f"{name:24s} no check SQL")
            continue
        try:
            diff, ts, tc = compare(spark, con, argv[0], name)
        except Exception as e:  # noqa: BLE001
            diff, ts, tc = "ERROR " + str(e).split("JVM stacktrace")[0][:900], 0, 0
        bad += diff is not None
        print(f"{name:24s} {'ok' if diff is None else 'DIFF'} spark {ts:.2f}s check {tc:.2f}s{'' if diff is None else chr(10) + '   ' + diff}", flush=True)
    print("different:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
