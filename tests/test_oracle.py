"""Every named query against its expected SQL, value by value."""

import pytest

import __spark_entry__ as entry
from tests.check import compare, duck

QUERIES, EXPECTED = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_matches_sql(spark, con, sf_dir, name):
    _, result = compare(spark, con, name, QUERIES[name], EXPECTED[name], sf_dir)
    assert result.startswith("ok"), result


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(EXPECTED)))
def test_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_every_expected_result_has_a_query():
    assert set(EXPECTED) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() == 9
