"""Every query of the core catalogue against its SQL."""

import os

import pytest

from tests.compare import connect, same
from tidemark import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, con, name):
    same(catalogue.queries()[name](spark, SF), con, catalogue.oracle_sql()[name])


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(catalogue.queries()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_series_ids_are_unique(spark):
    df = catalogue.series_id_fnv(spark, SF)
    assert df.select("series_id").distinct().count() == df.count()
    assert df.select("fnv").distinct().count() == df.select("event_type").distinct().count()
