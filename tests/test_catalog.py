import pytest

from lodestrata.plans import catalog
from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(name, same):
    same(catalog.QUERIES[name], catalog.SQL[name])


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())


def test_filters_reach_the_scan(spark):
    plan = catalog.QUERIES["time_range"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(put_at" in plan
    plan = catalog.QUERIES["ingest_outcome"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<message:string,attachment:struct<content:string>>" in plan
