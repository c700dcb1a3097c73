"""Every query with SQL gives the rows that DuckDB gives, at the smallest scale."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tessera.plans import project, registry, scans  # noqa: F401  the others add their queries to the registry

DATA = "/root/testdata/sf0.001"


def cell(x):
    if isinstance(x, (list, tuple)) or hasattr(x, "tolist") and getattr(x, "ndim", 0):
        return [cell(y) for y in x]
    if pd.isna(x):
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    return float(x) if isinstance(x, (int, float, np.number)) else str(x)


def rows(frame):
    cols = sorted(frame.columns)
    return sorted(repr([cell(x) for x in r]) for r in frame[cols].astype(object).itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    assert rows(registry.QUERIES[name](spark, DATA).toPandas()) == rows(con.sql(registry.ORACLE[name]).df())
