"""Compares a query with its SQL, as rows of values sorted by column name."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.execute(f"create view {t} as select * from read_parquet('{p / '*' if p.is_dir() else p}')")
    return con


def rows(frame: pd.DataFrame) -> list[str]:
    def plain(v):
        v = v.tolist() if hasattr(v, "tolist") else v
        return None if not isinstance(v, (list, dict)) and pd.isna(v) else v

    return sorted(repr(tuple(map(plain, r))) for r in frame[sorted(frame.columns)].itertuples(index=False))


def assert_same(spark, query, sql: str, sf_dir: str) -> None:
    mine, theirs = query(spark, sf_dir).toPandas(), connect(sf_dir).execute(sql).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)
