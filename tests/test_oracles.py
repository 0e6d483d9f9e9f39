import os

import pytest

from punctum import queries as core
from punctum.catalog import collected
from tests.oracle import DATA, check, connection

QUERIES = {**core.QUERIES, **collected()[0]}
SQL = {**core.SQL, **collected()[1]}

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connection()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    check(spark, con, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    QUERIES[name](spark, DATA).collect()
