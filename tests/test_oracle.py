"""Every report equals its SQL twin, value by value."""

import compare
import pytest
from compare import SMALL

import __spark_entry__ as entry
from revq.oracle import sql
from revq.plans import registry

QUERIES, SQL = registry.queries(), sql.all_queries()


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SMALL)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", QUERIES)
def test_equal(spark, duck, name):
    ours = compare.spark_rows(QUERIES[name](spark, SMALL))
    assert ours[1], "no rows"
    assert compare.difference(ours, compare.duck_rows(duck, SQL[name])) is None


def test_the_entry_holds_every_report():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
