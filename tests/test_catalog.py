"""Every query of the catalogue against its SQL."""

import pytest

import __spark_entry__
from piiprism.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(name, same):
    same(catalog.QUERIES[name], catalog.ORACLE_SQL[name])


def test_entry_has_a_stable_schema(spark):
    assert __spark_entry__.entry(spark).columns == ["entity", "hits", "docs"]


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
