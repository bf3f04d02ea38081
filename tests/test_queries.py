"""Registered queries against their SQL."""

import math

import duckdb
import pytest

from impulsia.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "orders lineitem customer events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == pytest.approx(b, rel=1e-6, abs=1e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    rows = [tuple(normal(r[c]) for c in cols) for r in df.collect()]
    assert rows
    if name not in registry.oracle_sql():
        return
    found = duck.sql(registry.oracle_sql()[name])
    assert sorted(found.columns) == cols
    at = [found.columns.index(c) for c in cols]
    want = [tuple(normal(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i]) for i in at) for r in found.fetchall()]
    assert len(rows) == len(want)
    keys = [i for i, c in enumerate(cols) if not isinstance(rows[0][i], float)]
    order = lambda r: tuple(str(r[i]) for i in keys)
    for a, b in zip(sorted(rows, key=order), sorted(want, key=order), strict=True):
        assert all(map(same, a, b)), (a, b)


def test_every_query_has_a_plain_name():
    assert all(n.isidentifier() for n in registry.queries()) and set(registry.oracle_sql()) <= set(registry.queries())
