import pytest

from tableferry import plans

from .oracle import oracle, rows_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    df = plans.QUERIES[name](spark, SF)
    assert rows_of(df.columns, df.collect()) == oracle(plans.ORACLE_SQL[name], SF)


def test_every_query_has_sql():
    assert set(plans.QUERIES) == set(plans.ORACLE_SQL)


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
