"""Registered queries against the SQL that gives the same rows, on the smallest tables."""

import os

import duckdb
import pytest

from cohortgraph.plans import catalogue

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_same_rows_as_sql(spark, tables, name):
    got = catalogue.QUERIES[name](spark, DIR)
    result = tables.execute(catalogue.ORACLE[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(got.columns)
    want = sorted(result.fetchall(), key=repr)
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)
    assert len(rows) == len(want) > 0 and len(want) == len(rows)
    assert rows == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE) - {"cv_summary", "cv_trees"}))  # Spark ML, some minutes
def test_others_give_rows(spark, name):
    assert catalogue.QUERIES[name](spark, DIR).count() > 0
