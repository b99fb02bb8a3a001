"""Every query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import numpy as np
import pytest

from tonguemill.plans import catalogue, durable  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(plain(y) for y in x)
    if isinstance(x, (float, np.floating)):
        return None if math.isnan(x) else round(float(x), 6)
    return x.item() if isinstance(x, np.generic) else x


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_matches_sql(spark, data, duck, name):
    df = catalogue.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    ours = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    got = duck.sql(catalogue.SQL[name]).df()
    assert sorted(got.columns) == cols
    got = got[cols].astype(object).where(got[cols].notna(), None)
    assert ours == sorted(repr(tuple(plain(v) for v in r)) for r in got.itertuples(index=False, name=None))


def test_rows_only(spark, data):
    for name in set(catalogue.QUERIES) - set(catalogue.SQL):
        assert catalogue.QUERIES[name](spark, data).count() > 0
