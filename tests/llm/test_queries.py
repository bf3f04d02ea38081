"""Registered corpus queries: their names, and those that SQL can express."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
from impulsia.llm import queries

DIR = "/root/testdata/sf0.001"


def test_all_ten_and_the_pipeline_are_registered():
    found = entry.queries()
    assert sorted(int(m[1]) for n in found if (m := re.match(r"op(\d+)_", n))) == list(range(1, 11)) and "pipeline" in found
    assert set(queries.oracle_sql()) <= set(queries.queries()) <= set(found)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, DIR)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(r[c] for c in want.columns) for r in got.collect()) == sorted(want.fetchall())
