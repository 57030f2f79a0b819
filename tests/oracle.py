"""Run a query and its DuckDB twin over the same tables and compare the rows."""

import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for name in sorted(os.listdir(sf_dir)):
        path = f"{sf_dir}/{name}"
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def _value(v):
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


def rows_of_spark(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(_value(r[c]) for c in columns) for r in df.collect())


def rows_of_duckdb(con, sql):
    rel = con.sql(sql)
    columns = sorted(rel.columns)
    at = [rel.columns.index(c) for c in columns]
    return columns, sorted(tuple(_value(r[i]) for i in at) for r in rel.fetchall())
