import os

import pytest

from siftwell.plans.queries import QUERIES, SQL
from tests.oracle import both, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, sf_dir, name):
    got, want = both(spark, con, sf_dir, QUERIES[name], SQL[name])
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1]) and got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
    assert os.path.exists(os.path.join(os.path.dirname(e.__file__), "bench.py"))
