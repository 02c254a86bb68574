"""Compare queries with their DuckDB twins the way the driver does (columns by name, rows in any order)."""

from __future__ import annotations

import math
import os
import sys

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _key(v):
    if v is None:
        return "~null"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str(v)


def compare(spark, folder: str, query, con) -> str:
    """Empty when equal, else what differs."""
    df = query.run(spark, folder)
    names = sorted(df.columns)
    got = [tuple(row[c] for c in names) for row in df.collect()]
    if query.sql is None:
        return "" if got else "no rows"
    cur = con.execute(query.sql)
    theirs = [d[0] for d in cur.description]
    if sorted(theirs) != names:
        return f"columns {names} != {sorted(theirs)}"
    order = [theirs.index(c) for c in names]
    want = [tuple(row[i] for i in order) for row in cur.fetchall()]
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for i, c in enumerate(names):
        kinds = {type(row[i]).__name__ for row in got if row[i] is not None}, {type(row[i]).__name__ for row in want if row[i] is not None}
        if kinds[0] != kinds[1]:
            return f"types of {c}: {kinds[0]} != {kinds[1]}"
    a = sorted(tuple(map(_key, row)) for row in got)
    b = sorted(tuple(map(_key, row)) for row in want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, first {bad[0]}" if bad else ""


if __name__ == "__main__":
    import time

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from kinelane.queries import all_queries
    from kinelane.session import local_session

    spark = local_session()
    base = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    con = connect(base)
    found = all_queries()
    for name in sys.argv[1:] or found:
        start = time.time()
        try:
            result = compare(spark, base, found[name], con)
        except Exception as error:  # noqa: BLE001
            result = f"{type(error).__name__}: {str(error)[:600]}"
        kind = "sql" if found[name].sql else "rows"
        print(f"{'ok  ' if not result else 'FAIL'} {name} [{kind}] {time.time() - start:.1f}s {result}", flush=True)
