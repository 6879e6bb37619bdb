"""Every query of the library proper against its SQL in DuckDB, at the smallest scale."""

import duckdb
import pytest

from isolayers.plans import lookup_queries, more_queries, ocean_queries, statistics_queries

DIR = "/root/testdata/sf0.001"
QUERIES = ocean_queries.QUERIES | statistics_queries.QUERIES | more_queries.QUERIES | lookup_queries.QUERIES
ORACLE = ocean_queries.ORACLE | statistics_queries.ORACLE | more_queries.ORACLE | lookup_queries.ORACLE


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DIR).toPandas(), duck.sql(ORACLE[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want)
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    for c in columns:
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c
