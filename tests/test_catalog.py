"""Every catalog query against its DuckDB equivalent on the smallest tables."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidemark.plans import catalog

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, dict):
        return {k: plain(x) for k, x in sorted(v.items())}
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, (list, tuple, np.ndarray)):
        return [plain(x) for x in v]
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, (float, np.floating)):
        return None if math.isnan(v) else f"{v:.6g}"
    return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(str([plain(v) for v in r]) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    got, want = catalog.QUERIES[name](spark, SMALL).toPandas(), con.execute(catalog.ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0
