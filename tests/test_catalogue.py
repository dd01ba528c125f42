import pytest
from compare import rows, sql_rows

from spotlake.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    want = sql_rows(catalogue.ORACLE_SQL[name], SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_and_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[:2] == ["group", "event"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
