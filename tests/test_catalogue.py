import pytest
from compare import assert_same, duck

from quernstone.plans.catalogue import QUERIES, SQL, flagship


@pytest.fixture(scope="module")
def con(folder):
    return duck(folder)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, folder, con, name):
    assert_same(QUERIES[name](spark, folder), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, folder, name):
    assert QUERIES[name](spark, folder).limit(5).collect()


def test_flagship_is_ranked(spark, folder):
    rows = flagship(spark, folder).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(1, len(rows) + 1))
    assert [r.score for r in rows] == sorted((r.score for r in rows), reverse=True)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_registers_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
