"""Compare a query with its DuckDB SQL on one folder of tables."""

import math
from pathlib import Path

import duckdb
import pandas as pd


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return str([_norm(x) for x in v])
    if isinstance(v, float) and not isinstance(v, bool):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, int) and not isinstance(v, bool):
        return repr(float(v))
    return str(v)


def _rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(str(_norm(v)) for v in r) for r in df[columns].itertuples(index=False)))


def connect(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def assert_same(query, sql, spark, sf_dir):
    got, want = _rows(query(spark, sf_dir).toPandas()), _rows(connect(sf_dir).execute(sql).df())
    assert got[0] == want[0]
    assert got[1] == want[1]
