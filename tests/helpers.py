"""Comparison of a Spark result with DuckDB's, and small frames."""

import os

import duckdb
import pandas as pd

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def duck(sql: str, folder: str) -> pd.DataFrame:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(folder):
        path = f"{folder}/{name}"
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con.execute(sql).df()


def plain(rows: pd.DataFrame, columns: list[str]) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA:
            return None
        if hasattr(v, "isoformat"):
            return str(pd.Timestamp(v))
        if isinstance(v, bool):
            return v
        try:
            return round(float(v), 4)
        except (TypeError, ValueError):
            return str(v)

    return sorted((tuple(one(v) for v in row) for row in rows[columns].astype(object).itertuples(index=False)), key=repr)


def assert_same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = plain(got, columns), plain(want, columns)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == y
