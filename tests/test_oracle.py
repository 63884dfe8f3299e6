"""Every audit query against its SQL, and those without SQL for rows and a stable schema."""

import pytest

from hostlens.plans import queries as q

from .conftest import same_rows


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_query_equals_sql(name, spark, sf, duck):
    same_rows(q.QUERIES[name](spark, sf), duck, q.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLE_SQL)))
def test_query_without_sql_runs(name, spark, sf):
    df = q.QUERIES[name](spark, sf)
    assert df.count() > 0
    assert q.QUERIES[name](spark, sf).schema == df.schema


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())
