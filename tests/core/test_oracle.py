"""Every registered query against its SQL twin on the smallest tables."""

import math

import duckdb
import pytest

from graphloom import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def shown(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{v:.9g}" if isinstance(v, float) else f"{float(v):.9g}" if hasattr(v, "as_tuple") else str(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, con, name):
    got = catalog.queries()[name](spark, SF)
    want = con.sql(catalog.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    a = sorted(tuple(shown(r[c]) for c in columns) for r in got.collect())
    b = sorted(tuple(shown(r[k]) for k in at) for r in want.fetchall())
    assert a == b and a


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
