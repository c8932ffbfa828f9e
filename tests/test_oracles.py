"""Every registered query against its SQL oracle on the smallest tables."""

import pytest
from oracle_check import compare, connect

from __spark_entry__ import entry, queries
from plumbline.plans.catalog import QUERIES
from plumbline.plans.oracles import ORACLES


@pytest.fixture(scope="module")
def db(sf_dir):
    return connect(sf_dir)


def test_entry(spark):
    assert entry(spark).count() == 1


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES) <= set(queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, sf_dir, name):
    assert compare(spark, db, sf_dir, QUERIES[name], ORACLES[name]) == ""
