"""Queries against their SQL on the driver's smallest tables."""

import os

import duckdb
import pytest

from placelink.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, tables, name):
    want = tables.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_left_out_rungs_are_not_reached(spark):
    methods = {r.method for r in queries.token_ladder(spark, "/root/testdata/sf0.01").select("method").distinct().collect()}
    assert methods == {"exact", "abbreviation", "alternate_name", "stem", "fuzzy", "substring_result_in_query", "substring_query_in_result", "none"}
