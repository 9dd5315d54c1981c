"""Every registered query against its SQL, on the smallest tables."""

import pytest

import tools_compare
import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return tools_compare.connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_same_as_sql(spark, duck, name):
    problem = tools_compare.compare(spark, duck, name, SF)
    assert problem is None, problem


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
