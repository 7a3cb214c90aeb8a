"""Every registered query against its SQL oracle."""

import os

import pytest
from compare import connect, differences

import __spark_entry__ as contract
from tidewarden.plans.oracles import ORACLES
from tidewarden.plans.queries import REGISTRY

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(REGISTRY) == set(ORACLES)
    assert set(REGISTRY) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query_matches_sql(spark, con, name):
    assert differences(contract.queries()[name](spark, SF_DIR), con, contract.oracle_sql()[name]) == []


def test_entry(spark):
    assert contract.entry(spark).count() > 0
