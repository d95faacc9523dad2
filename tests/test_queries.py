"""Every named query against its SQL twin, and the rest for rows and a stable schema."""

import pytest

import __spark_entry__ as e
from tests.compare import compare, connect

SQL, QUERIES = e.oracle_sql(), e.queries()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, sf_dir, name):
    assert compare(spark, con, QUERIES[name], SQL[name], sf_dir) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"choose_topic_count"}))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    df = e.entry(spark)
    assert df.columns[:4] == ["doc_id", "lang", "source", "label"]
    labels = [r.label for r in df.select("label").collect()]
    assert labels and labels.count(0) == labels.count(1)
