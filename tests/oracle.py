"""Running a query and its SQL on the same tables and comparing rows."""

import glob
import os

import duckdb

SMALL = "/root/testdata/sf0.001"


def connect(folder: str = SMALL):
    d = duckdb.connect()
    d.sql("SET timezone = 'UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        d.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return d


def _plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if hasattr(v, "tzinfo") and v.tzinfo:
        return v.replace(tzinfo=None)
    if isinstance(v, list):
        return tuple(_plain(x) for x in v)
    return v


def same(df, sql: str, d) -> tuple[list, list]:
    cols = sorted(df.columns)
    r = d.sql(sql)
    assert sorted(r.columns) == cols
    at = [r.columns.index(c) for c in cols]
    got = sorted((tuple(_plain(x[c]) for c in cols) for x in df.collect()), key=repr)
    want = sorted((tuple(_plain(x[i]) for i in at) for x in r.fetchall()), key=repr)
    return got, want
