"""Runs a query and its SQL on the same tables and compares their rows."""

from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def cell(v):
    if isinstance(v, float):
        return f"{v:.6f}"
    return "" if v is None else str(v)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in found)


def same(spark, query, sql, sf=SF):
    db = duckdb.connect()
    db.sql("SET TimeZone = 'UTC'")
    for f in Path(sf).glob("*.parquet"):
        db.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df, told = query(spark, sf), db.sql(sql)
    assert rows(df.columns, df.collect()) == rows(told.columns, told.fetchall())
