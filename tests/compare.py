"""Holds queries against their SQL twins in DuckDB: python tests/compare.py [folder] [names]."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v) if v is not None and not isinstance(v, (int, str, bool)) else v


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def oracle(folder: str, sql: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return names, rows_of(names, got.fetchall())


def differences(spark, folder: str, f, sql: str) -> str:
    """Empty if the rows are the same."""
    df = f(spark, folder)
    got = rows_of(df.columns, df.collect())
    names, want = oracle(folder, sql)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got == want:
        return ""
    bad = [(a, b) for a, b in zip(got, want) if a != b][:2]
    return f"{len(got)} and {len(want)} rows, first differences {bad}"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from heronry.plans.catalogue import ORACLE_SQL, QUERIES
    from heronry.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    spark.sparkContext.setLogLevel("OFF")
    for name in sys.argv[2:] or QUERIES:
        began = time.time()
        try:
            said = differences(spark, folder, QUERIES[name], ORACLE_SQL[name]) if name in ORACLE_SQL else f"no SQL; {QUERIES[name](spark, folder).count()} rows"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:600]}"
        if said or "-v" in sys.argv:
            print(f"{name} ({time.time() - began:.1f} s): {said[:900]}", flush=True)
    print(len(QUERIES), "queries", flush=True)
