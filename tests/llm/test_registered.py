"""What the entry file offers of this subpackage, and queries beside their SQL."""

import re

import pytest

import __spark_entry__ as entry
from docwarden.llm import registry
from oracle import compare, connect

SF = "/root/testdata/sf0.001"


def test_one_query_per_operator_and_the_pipeline():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_query_matches_its_sql(spark, name):
    columns, want_columns, got, want = compare(spark, connect(SF), SF, entry.queries()[name], entry.oracle_sql()[name])
    assert columns == want_columns and got == want
