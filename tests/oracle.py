"""Side-by-side comparison with DuckDB."""

import datetime
import glob
import os

import duckdb

SMALL = "/root/testdata/sf0.001"


def connection(sf_dir=SMALL):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def assert_same(df, con, sql):
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = con.sql(sql)
    want = rows_of(found.columns, found.fetchall())
    assert sorted(df.columns) == sorted(found.columns)
    assert len(got) == len(want)
    assert got == want
