"""Every registered query against its SQL, on whole tables."""

import pytest

import __spark_entry__ as entry
from compare import differences, sql_engine
from tabweave.workload import oracle, queries as registered

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def engine():
    return sql_engine(FOLDER)


@pytest.mark.parametrize("name", sorted(registered.QUERIES))
def test_query(spark, engine, name):
    frame = registered.QUERIES[name](spark, FOLDER).toPandas()
    assert len(frame) > 0
    if name in oracle.SQL:
        assert differences(frame, engine.sql(oracle.SQL[name]).df()) is None


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns[0] == "id" and frame.count() == 6000
