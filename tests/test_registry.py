"""Every registered query runs on the smallest tables, and agrees with its SQL."""

import os

import duckdb
import pytest

from corpusloom.plans import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(str(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    if name in registry.oracle_sql():
        answer = con.execute(registry.oracle_sql()[name])
        named = [x[0] for x in answer.description]
        assert sorted(named) == columns
        assert got == sorted(str(tuple(plain(r[named.index(c)]) for c in columns)) for r in answer.fetchall())
