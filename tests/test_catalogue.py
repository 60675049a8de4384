import pytest

from stratasift.plans import catalogue, inventory
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, name):
    assert_same(spark, catalogue.QUERIES[name], catalogue.ORACLES[name], "/root/testdata/sf0.001")


def test_entry_module_has_sql_for_all_catalogue_queries():
    import __spark_entry__

    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES) and inventory.QUERIES is catalogue.QUERIES


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
