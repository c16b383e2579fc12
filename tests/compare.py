"""Compares a query's rows with those of its SQL in DuckDB."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def settled(x: pd.DataFrame) -> pd.DataFrame:
    x = x[sorted(x.columns)].copy()
    for k in x.columns:
        if x[k].dtype.kind in "iufb":
            x[k] = x[k].astype(float)
        else:
            x[k] = x[k].map(lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)) else str(v))
    return x.sort_values(list(x.columns)).reset_index(drop=True)


def assert_same(a: pd.DataFrame, b: pd.DataFrame, tolerance: float = 2e-6) -> None:
    assert sorted(a.columns) == sorted(b.columns)
    assert len(a) == len(b)
    a, b = settled(a), settled(b)
    for k in a.columns:
        if a[k].dtype.kind == "f" and b[k].dtype.kind == "f":
            assert np.allclose(a[k], b[k], atol=tolerance, rtol=1e-9, equal_nan=True), k
        else:
            assert (a[k].astype(str) == b[k].astype(str)).all(), k
