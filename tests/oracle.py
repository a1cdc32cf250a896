"""Compare a query with its SQL in DuckDB: columns by name, rows in any order."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES.split():
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def norm(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    if hasattr(value, "tolist"):
        return norm(value.tolist())
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def assert_same(df, sql, con):
    found = con.sql(sql)
    want_columns = list(found.columns)
    got = df.collect()
    assert sorted(df.columns) == sorted(want_columns)
    assert rows_of(df.columns, got) == rows_of(want_columns, found.fetchall())
