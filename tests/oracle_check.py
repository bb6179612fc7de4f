"""Run registered queries next to their SQL and compare: row count, column names
and order-free values. Usage: ``python tests/oracle_check.py [sf_dir] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    text = lambda v: str(v + 0.0 if isinstance(v, float) else v)  # noqa: E731  (-0.0 equals 0.0)
    return names, sorted((tuple(text(v) for v in r) for r in df[names].astype(object).itertuples(index=False)))


def compare(spark, con, sf_dir: str, name: str) -> str:
    df = entry.queries()[name](spark, sf_dir)
    got = df.toPandas()
    plan = df._jdf.queryExecution().toString()
    for bad in ("CartesianProduct", "NestedLoopJoin"):
        if bad in plan:
            return f"FAIL plan has {bad}"
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"rows only: {len(got)}"
    want = con.execute(sql).fetch_df()
    (gn, gr), (wn, wr) = rows_of(got), rows_of(want)
    if gn != wn:
        return f"FAIL columns {gn} {wn}"
    types = {c: (str(got[c].dtype), str(want[c].dtype)) for c in gn if str(got[c].dtype) != str(want[c].dtype)}
    if gr != wr:
        left = [r for r in gr if r not in set(wr)][:3]
        right = [r for r in wr if r not in set(gr)][:3]
        return f"FAIL rows {len(gr)} {len(wr)} only in query {left} only in SQL {right} {types}"
    return f"ok {len(gr)} {types or ''}"


def main() -> None:
    from tests.session import local_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark, con = local_session(), connect(sf_dir)
    for name in args or entry.queries():
        start = time.time()
        try:
            result = compare(spark, con, sf_dir, name)
        except Exception as error:  # noqa: BLE001
            result = f"FAIL {type(error).__name__} {str(error)[:600]}"
        print(f"{time.time() - start:6.1f}s {name}: {result}", flush=True)


if __name__ == "__main__":
    main()
