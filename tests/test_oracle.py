"""Every registered query with SQL gives the same rows in both engines."""

import oracle
import pytest

from support import SMALL
from fieldpulse.plans.catalog import QUERIES


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SMALL)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_same_rows(spark, con, name):
    query = QUERIES[name]
    assert oracle.differences(query.run(spark, SMALL), con, query.sql) is None


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if not q.sql])
def test_has_rows(spark, name):
    assert not QUERIES[name].run(spark, SMALL).isEmpty()
