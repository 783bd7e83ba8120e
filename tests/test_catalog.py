import pytest
from compare import differences

from graphlens.plans import catalog, oracle

FOLDER = "/root/testdata/sf0.001"
SQL = oracle.oracle_sql()


def test_every_query_has_sql():
    assert set(SQL) == set(catalog.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    assert differences(spark, FOLDER, catalog.queries()[name], SQL[name]) == ""
