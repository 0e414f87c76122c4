"""Every query with an oracle gives DuckDB's result on the small tables; the others must run and give rows."""

import os

import pytest

import __spark_entry__ as entry

from compare import check, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    n, msg = check(spark, con, name, SF, QUERIES, ORACLES)
    assert n > 0
    assert not msg, msg
