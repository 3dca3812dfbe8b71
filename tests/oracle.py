"""Comparison of a query's rows with those of its SQL, without regard to order."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"{float(v) + 0.0:.5f}"
        return str(v)

    df = df.astype(object)[sorted(df.columns)]
    return sorted(tuple(cell(v) for v in row) for row in df.itertuples(index=False))


def differences(spark_df, sql: str, con) -> list:
    ours, theirs = spark_df.toPandas(), con.execute(sql).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    a, b = canonical(ours), canonical(theirs)
    return [] if a == b else [len(a), len(b), *sorted(set(a) ^ set(b))[:4]]
