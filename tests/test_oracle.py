"""Every registered query with a SQL twin gives the same rows as DuckDB."""

import pytest

import __spark_entry__ as registry
from checks import oracle
from checks.compare import connect, differences

QUERIES, SQL = registry.own_queries(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def duck(folder):
    return connect(folder)


def test_every_twin_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)
    fitted = {f"{model}_model_{what}" for model in ("baseline", "recent") for what in ("scores", "evaluation")}
    assert set(QUERIES) - set(SQL) == fitted


def test_entry(spark):
    assert registry.entry(spark).count() == 5


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, folder, duck, name):
    assert differences(QUERIES[name](spark, folder), duck.sql(SQL[name])) == []


def test_all_are_registered():
    assert set(QUERIES) <= set(registry.queries()) and set(SQL) <= set(registry.oracle_sql())
