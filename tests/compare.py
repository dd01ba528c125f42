"""Runs a registered query and its SQL over the same tables."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(sql: str, sf_dir: str) -> pd.DataFrame:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con.sql(sql).df()


def rows(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)].astype(object)
    plain = lambda x: None if pd.isna(x) else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x
    return sorted(str([plain(x) for x in r]) for r in frame.itertuples(index=False))
