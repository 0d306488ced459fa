"""Compare registered queries with their SQL on DuckDB.

Run ``python tests/oracle.py [folder] [name ...]`` for a report.
"""

from __future__ import annotations

import datetime
import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(folder: str):
    import duckdb
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(repr(value)) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    return value


def normal(columns: list[str], rows: list) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0)
                                           for v in r))


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs first."""
    got = normal(df.columns, df.collect())
    rel = con.sql(sql)
    want = normal(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} != {sorted(rel.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows, want {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"row {a} != {b} (columns {sorted(df.columns)})"
        for x, y in zip(a, b):
            if type(x) is not type(y):
                return f"types {a} != {b}"
    return None


def main(argv: list[str]) -> int:
    from terrier.queries import ALL
    from terrier.session import local_session
    folder = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(ALL)
    spark, con, bad = local_session(8), duck(folder), 0
    for name in names:
        start = time.time()
        try:
            df = ALL[name].run(spark, folder)
            if ALL[name].sql is None:
                result = f"rows only: {df.count()}"
            else:
                result = compare(df, con, ALL[name].sql)
        except Exception as error:  # report and go on
            result = f"{type(error).__name__}: {str(error)[:600]}"
        ok = result is None or result.startswith("rows only")
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name} {time.time() - start:.1f}s {result or ''}", flush=True)
    print(f"{bad} of {len(names)} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
