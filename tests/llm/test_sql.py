"""The operators' queries against their SQL on the smallest tables."""

import duckdb
import pytest

from tests.test_oracle import TABLES, plain
from tonguemill.llm import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, data, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    df = registry.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    ours = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    got = con.sql(registry.SQL[name]).df()
    assert sorted(got.columns) == cols
    got = got[cols].astype(object).where(got[cols].notna(), None)
    assert ours == sorted(repr(tuple(plain(v) for v in r)) for r in got.itertuples(index=False, name=None))
