"""Every query that SQL can express gives what its SQL gives, over the whole small tables."""

import pytest
from conftest import SMALL
from oracle_check import compare, connect

from pressloom.plans.oracles import ORACLES
from pressloom.plans.registry import QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_names_belong_together():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, name, SMALL) is None
