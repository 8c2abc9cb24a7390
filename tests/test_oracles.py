"""Every registered query beside its SQL, at the smallest scale."""

import pytest

import __spark_entry__ as entry
from docwarden.plans import registry
from oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_an_oracle():
    assert set(registry.ORACLES) == set(registry.QUERIES)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_matches_its_oracle(spark, con, name):
    columns, want_columns, got, want = compare(spark, con, SF, entry.queries()[name], entry.oracle_sql()[name])
    assert columns == want_columns
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
