"""Compare a query with its SQL in DuckDB, regardless of order."""

import os

import duckdb


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in values)


def same(df, sql, sf_dir):
    db = duckdb.connect()
    for name in sorted(os.listdir(sf_dir)):
        db.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    found = db.execute(sql)
    columns = [c[0] for c in found.description]
    want = rows(columns, found.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert sorted(columns) == sorted(df.columns)
    assert got == want, [x for x in zip(got, want) if x[0] != x[1]][:2]
    return len(got)
