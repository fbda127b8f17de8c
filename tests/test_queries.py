"""Every registered query against its SQL, on the smallest tables; those without SQL must give rows."""

import os

import oracle
import pytest

from quarrylight.queries import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    names, rows = oracle.rows_of(QUERIES[name](spark, SF))
    if name in SQL:
        assert (names, rows) == oracle.sql_rows(duck, SQL[name])
    else:
        assert rows


def test_entry_registers_everything(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(SQL) <= set(e.oracle_sql()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["qid", "rank", "doc_id", "score", "label"]
