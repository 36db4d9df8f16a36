"""Every core query against its SQL in DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from ledgerloom.plans import catalog_queries, data_queries, reconcile_queries, round_trips, rule_queries

FOLDER = Path("/root/testdata/sf0.001")
QUERIES = {**data_queries.QUERIES, **catalog_queries.QUERIES, **reconcile_queries.QUERIES, **rule_queries.QUERIES, **round_trips.QUERIES}
SQL = {**data_queries.SQL, **catalog_queries.SQL, **reconcile_queries.SQL, **rule_queries.SQL, **round_trips.SQL}
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="the test tables aren't here")


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from '{path}'")
    return con


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return [normal(v) for v in value] if isinstance(value, list) else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, views, name):
    df = QUERIES[name](spark, str(FOLDER))
    columns = sorted(df.columns)
    got = sorted((tuple(map(normal, r)) for r in df.select(*columns).collect()), key=repr)
    if name not in SQL:
        assert got
        return
    result = views.sql(SQL[name])
    assert sorted(result.columns) == columns
    order = [result.columns.index(c) for c in columns]
    assert got == sorted((tuple(normal(r[i]) for i in order) for r in result.fetchall()), key=repr)


def test_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
