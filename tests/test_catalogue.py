"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import compare

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    compare.tables(c, FOLDER)
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    assert compare.difference(entry.queries()[name](spark, FOLDER), duck, entry.oracle_sql()[name]) == ""


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["document_id", "chunk_id", "doc_rank", "passage_rank", "score"]
