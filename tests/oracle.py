"""Compares a query with its SQL in DuckDB, rows in any order, columns by name."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _rows(rows):
    return sorted(tuple("%.9g" % v if isinstance(v, float) else str(v) for v in r) for r in rows)


def check(spark, con, folder: str, query, sql: str) -> None:
    df = query(spark, folder)
    columns = sorted(df.columns)
    found = con.sql(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({sql})")
    assert sorted(con.sql(sql).columns) == columns
    assert _rows(tuple(r) for r in df.select(*columns).collect()) == _rows(found.fetchall())
