"""Every registered query of the reference's operators against its SQL, at the smallest scale."""

import glob
import os

import pytest

from foliospark import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    sql = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in sql.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted([tuple(str(plain(r[i])) for i in at) for r in sql.fetchall()])
    assert sorted(tuple(str(plain(r[c])) for c in columns) for r in got.collect()) == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
