"""A Spark result against DuckDB's for the same tables."""

import os

import duckdb

DATA = "/root/testdata/sf0.001"


def connect(data: str = DATA):
    con = duckdb.connect()
    for name in os.listdir(data):
        con.execute(f"CREATE VIEW {name.partition('.')[0]} AS FROM '{data}/{name}'")
    return con


def plain(value) -> str:
    if isinstance(value, float):
        return f"{value:.9g}"
    return "[" + ",".join(map(plain, value)) + "]" if isinstance(value, list | tuple) else str(value)


def same(df, con, sql: str) -> None:
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    columns = sorted(df.columns)
    assert sorted(names) == columns
    expected = sorted(tuple(plain(row[names.index(c)]) for c in columns) for row in found.fetchall())
    assert sorted(tuple(plain(row[c]) for c in columns) for row in df.collect()) == expected
