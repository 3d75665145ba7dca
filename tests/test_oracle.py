"""Every query of the library against its SQL, over whole tables."""

import os

import pytest

from tests.oracle import connect, rows_of_spark, rows_of_sql
from tomeflow.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    assert rows_of_spark(df) == rows_of_sql(con, catalogue.ORACLE_SQL[name], df.columns)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalogue.QUERIES[name](spark, FOLDER).count() > 0


def test_entry_has_rows_and_the_catalogue_stands_alone():
    import __spark_entry__

    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
