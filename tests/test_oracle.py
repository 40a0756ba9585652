import pytest

from foliant.plans import registry

from compare import SF, connection, rows_of_spark, rows_of_sql


@pytest.fixture(scope="module")
def duck():
    return connection()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, duck, name):
    names, rows = rows_of_spark(registry.QUERIES[name](spark, SF))
    assert (names, rows) == rows_of_sql(duck, registry.ORACLE[name])


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE)
