"""Run queries against their SQL counterparts: ``python -m checks.compare [folder] [key ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def duck_session(folder: str):
    con = duckdb.connect()
    for name in sorted(os.listdir(folder)):
        table = name.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{name}'")
    return con


def compare(spark, con, folder: str, key: str, query, sql: str | None):
    """(same, message, seconds) for one query."""
    begin = time.time()
    df = query(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    seconds = time.time() - begin
    if sql is None:
        return True, f"{len(got[1])} rows, no SQL", seconds
    result = con.execute(sql)
    want = rows_of([d[0] for d in result.description], result.fetchall())
    if got == want:
        return True, f"{len(got[1])} rows", seconds
    if got[0] != want[0]:
        return False, f"columns {got[0]} != {want[0]}", seconds
    ours, theirs = set(got[1]) - set(want[1]), set(want[1]) - set(got[1])
    return False, f"{len(got[1])}/{len(want[1])} rows, only here {sorted(ours)[:3]}, only there {sorted(theirs)[:3]}", seconds


def main() -> int:
    from veilspark.session import build_session

    from .answers import ANSWERS
    from .queries import QUERIES

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:] or list(QUERIES)
    spark = build_session("local[8]", 8, spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck_session(folder)
    bad = 0
    for key in keys:
        try:
            same, message, seconds = compare(spark, con, folder, key, QUERIES[key], ANSWERS.get(key))
        except Exception as error:  # noqa: BLE001 - a broken query must not hide the others
            same, message, seconds = False, f"{type(error).__name__}: {str(error)[:600]}", 0.0
        bad += not same
        print(f"{'ok ' if same else 'BAD'} {key:28s} {seconds:6.2f}s {message}", flush=True)
    print(f"{len(keys) - bad} of {len(keys)} agree")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
