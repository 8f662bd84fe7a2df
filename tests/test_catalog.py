"""Every registered query against its DuckDB oracle on the smallest test tables."""

import pytest

import __spark_entry__ as entry
from tests.paths import SF_SMOKE
from oracle_util import compare, duck
from promptlens.plans import catalog

QUERIES = {name: fn for name, fn in entry.queries().items() if name in catalog.QUERIES}
ORACLES = {name: sql for name, sql in entry.oracle_sql().items() if name in catalog.QUERIES}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMOKE)


def test_every_query_has_an_oracle_or_a_reason():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    problems, _ = compare(QUERIES[name](spark, SF_SMOKE), con, ORACLES[name])
    assert not problems, problems


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "section" in df.columns
