"""Run every query next to its SQL and compare row counts and values."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import os
import sys
import time

import duckdb

from docnest.session import session
from workload.oracle import ORACLE
from workload.queries import QUERIES


def canonical(value):
    if isinstance(value, decimal.Decimal):
        return str(value.normalize() + 0)
    if isinstance(value, float):
        return repr(round(value, 9))
    if isinstance(value, (dt.date, dt.datetime)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return [canonical(v) for v in value]
    return value


def canonical_rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(repr([canonical(r[i]) for i in order]) for r in data)


def connect(folder: str):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def compare(spark, con, name: str, folder: str) -> tuple[bool, str]:
    start = time.time()
    df = QUERIES[name](spark, folder)
    left = canonical_rows(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - start
    if name not in ORACLE:
        return True, f"{len(left[1])} rows, no SQL, {spent:.1f}s"
    result = con.execute(ORACLE[name])
    right = canonical_rows([d[0] for d in result.description], result.fetchall())
    if left == right:
        return True, f"{len(left[1])} rows, {spent:.1f}s"
    if left[0] != right[0]:
        return False, f"columns {left[0]} against {right[0]}"
    ours, theirs = set(left[1]), set(right[1])
    extra, lacking = sorted(ours - theirs)[:3], sorted(theirs - ours)[:3]
    return False, f"{len(left[1])} against {len(right[1])} rows; only here {extra}; only there {lacking}"


def main(folder: str, names: list[str]) -> int:
    spark = session("docnest-check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in names or list(QUERIES):
        try:
            good, note = compare(spark, con, name, folder)
        except Exception as error:  # noqa: BLE001 - report every query, whatever happens
            good, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not good
        print("ok  " if good else "FAIL", name, note, flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
