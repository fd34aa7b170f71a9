"""Every query with SQL gives the rows that DuckDB gives; the others give rows."""

import os

import numpy as np
import pytest

from nocturne.plans import registry

duckdb = pytest.importorskip("duckdb")
registry.load()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def value(x):
    if x is None or (isinstance(x, float) and x != x) or str(x) in ("NaT", "<NA>"):
        return None
    if isinstance(x, (list, np.ndarray)):
        return [value(v) for v in x]
    if isinstance(x, (int, float, np.integer, np.floating)) and not isinstance(x, (bool, np.bool_)):
        return round(float(x), 5) + 0.0
    return str(x)


def rows(df):
    return sorted(str([value(x) for x in r]) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, con, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), con.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
