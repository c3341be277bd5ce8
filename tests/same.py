"""Compares a query with its SQL twin: columns by name, rows in any order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(sf_dir, text):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con.sql(text).df()


def normal(frame):
    cols = sorted(frame.columns)
    return cols, frame[cols].astype(object).where(frame[cols].notna(), None).astype(str).sort_values(cols).to_numpy().tolist()


def assert_same(got, want):
    (a, x), (b, y) = normal(got), normal(want)
    assert a == b
    assert len(x) == len(y)
    assert x == y
