"""Compares a Spark result with DuckDB over the same tables."""

from pathlib import Path

import duckdb

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def check(df, sql, folder):
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    rel = con.sql(sql)
    names = rel.columns
    assert sorted(names) == sorted(df.columns)
    assert {k: TYPES[v] for k, v in df.dtypes} == dict(zip(names, map(str, rel.types), strict=True))
    order = [names.index(c) for c in df.columns]
    want = sorted(repr(tuple(r[i] for i in order)) for r in rel.fetchall())
    assert sorted(repr(tuple(r)) for r in df.collect()) == want
