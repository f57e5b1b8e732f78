"""Every registered query against plain SQL in DuckDB, values and column types."""

import duckdb
import pytest

from verification.oracle import ORACLE
from verification.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer orders lineitem".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


def test_oracles_use_no_cross_join():
    for sql in ORACLE.values():
        assert "cross join" not in sql.lower()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF_DIR)
    columns = sorted(got.columns)
    want = duck.execute(ORACLE[name])
    assert sorted(d[0] for d in want.description) == columns
    place = {d[0]: i for i, d in enumerate(want.description)}
    expected = [tuple(str(row[place[c]]) for c in columns) for row in want.fetchall()]
    actual = [tuple(str(row[c]) for c in columns) for row in got.collect()]
    assert sorted(actual) == sorted(expected)
