"""Compares a Spark result with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

import os

import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df:
        if pd.api.types.is_numeric_dtype(df[c]) and not pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype("float64").round(6)
        elif df[c].dtype == object:
            df[c] = df[c].map(lambda v: None if v is None else round(v, 6) if isinstance(v, float) else str(v))
    return df.astype(str).sort_values(list(df.columns)).reset_index(drop=True)


def database(d: str = SMALL):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{d}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    return con


def same(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> None:
    assert sorted(spark_rows.columns) == sorted(sql_rows.columns)
    assert len(spark_rows) == len(sql_rows)
    a, b = normal(spark_rows), normal(sql_rows)
    for c in a:
        assert (a[c] == b[c]).all(), (c, a[c][a[c] != b[c]].head().tolist(), b[c][a[c] != b[c]].head().tolist())
