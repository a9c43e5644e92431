"""Runs a registered query and its SQL side by side."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from worldstate.plans.views import TABLES


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if hasattr(value, "item"):
        return value.item()
    return value


def _sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=repr)


def compare(spark, con, name: str, run, sql: str | None, folder: str) -> str:
    """Empty text when rows match, else what differs."""
    started = time.time()
    df = run(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - started
    if sql is None:
        return "" if rows else "no rows"
    got_names, got = _sorted_rows(df.columns, rows)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want_names, want = _sorted_rows(names, cur.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)} rows; {got[:2]} {want[:2]}"
    for a, b in zip(got, want):
        if repr(a) != repr(b):
            return f"row {a} != {b} ({took:.1f}s)"
    return "" if got else "both empty"


if __name__ == "__main__":
    from worldstate.session import build_session
    from __spark_entry__ import oracle_sql, queries

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session("local[8]")
    con, sqls = connect(folder), oracle_sql()
    bad = 0
    for name, run in queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        started = time.time()
        try:
            problem = compare(spark, con, name, run, sqls.get(name), folder)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += bool(problem)
        mark = "ok" if not problem else "BAD"
        print(f"{mark:4}{name:28}{time.time() - started:6.1f}s {'sql' if name in sqls else 'rows'} {problem}", flush=True)
    print("bad:", bad)
