"""Comparison of a Spark result with a DuckDB statement, order and column order aside."""

from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.001"


def connect(d: str = DATA):
    c = duckdb.connect()
    for p in sorted(Path(d).glob("*.parquet")):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def norm(df):
    df = df[sorted(df.columns)].copy()
    for k in df.columns:
        if df[k].dtype.kind == "f":
            df[k] = df[k].round(5) + 0.0
    return df.astype(str).sort_values(list(df.columns)).reset_index(drop=True)


def same(result, sql: str, d: str = DATA) -> None:
    a, b = result.toPandas(), connect(d).execute(sql).fetchdf()
    assert sorted(a.columns) == sorted(b.columns)
    assert len(a) == len(b)
    assert norm(a).equals(norm(b))
