"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle import compare, connect

from archivolt import plans

plans.load_all()
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_matches_sql(spark, con, name):
    assert compare(spark, con, plans.QUERIES[name], plans.ORACLES[name], FOLDER) == []


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_runs_without_sql(spark, name):
    assert plans.QUERIES[name](spark, FOLDER).count() > 0
