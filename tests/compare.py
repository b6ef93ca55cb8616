"""Runs a query and its SQL over the same tables and compares all rows."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(df: pd.DataFrame, names: list[str]) -> pd.DataFrame:
    df = df[names].copy()
    for n in names:
        if pd.api.types.is_bool_dtype(df[n]) or not pd.api.types.is_numeric_dtype(df[n]):
            df[n] = df[n].astype(str)
        else:
            df[n] = df[n].astype(float).map(lambda v: "null" if v != v else repr(v + 0.0))
    return df.replace({"None": "null", "NaN": "null", "nan": "null", "<NA>": "null", "NaT": "null"}).sort_values(names).reset_index(drop=True)


def same(spark, query, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    got, want = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    pd.testing.assert_frame_equal(_plain(got, names), _plain(want, names))
