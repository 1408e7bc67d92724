"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle import compare, connect

from ampledger.plans import load_all

FOLDER = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
REGISTRY = load_all()
MAY_BE_EMPTY = {"v7_dominant_values", "a13_mostly_zero", "v8_zero_variance", "r6_declining_low_users"}


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query_agrees_with_sql(spark, duck, name):
    problem = compare(spark, duck, REGISTRY[name], FOLDER)
    if problem == "both empty":  # too few rows there for some findings
        problem = compare(spark, connect(LARGER), REGISTRY[name], LARGER)
    assert problem == "" or (problem == "both empty" and name in MAY_BE_EMPTY), problem


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
