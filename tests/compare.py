"""Compares a query's rows with DuckDB's, in any order, doubles to nine places."""

import os
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)


def sql_rows(sf_dir, sql):
    con = duckdb.connect()
    for p in Path(sf_dir).iterdir():
        files = f"{p}/*.parquet" if os.path.isdir(p) else str(p)
        con.execute(f"CREATE VIEW {p.name.removesuffix('.parquet')} AS SELECT * FROM '{files}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)


def same(df, sf_dir, sql):
    assert rows(df) == sql_rows(sf_dir, sql)
