"""Every named query runs and, where it has checking SQL, agrees with it."""

import os

import pytest

from oracle import compare, connect
from uptake.plans.catalog import ORACLES, QUERIES

SF_DIR = os.environ.get("UPTAKE_TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in ORACLES:
        assert compare(df, con, ORACLES[name]) == ""
    else:
        df.write.format("noop").mode("overwrite").save()


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
