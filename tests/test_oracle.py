import os

import pytest

from oracle import connect, difference
from starfold.queries import ORACLES, QUERIES

FOLDER = os.environ.get("STARFOLD_TEST_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert difference(QUERIES[name](spark, FOLDER), con, ORACLES[name]) is None
