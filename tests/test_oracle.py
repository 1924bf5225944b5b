"""Every registered query against its SQL on the smallest test set."""

import os

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry_points
from riffle.plans import oracle
from riffle.plans import queries as catalogue

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.registered(), oracle.sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry_points.queries()) and set(SQL) <= set(entry_points.oracle_sql())


def test_no_event_is_lost(spark):
    events = spark.read.parquet(f"{SF_DIR}/events.parquet").count()
    for name in ("lenient_cast", "stamp_run", "parse_times", "unit_normalise"):
        assert QUERIES[name](spark, SF_DIR).count() == events
    assert sum(r["rows"] for r in QUERIES["audit_rows"](spark, SF_DIR).collect()) == events


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    assert compare(QUERIES[name](spark, SF_DIR), duck.sql(SQL[name])) == []


def test_entry(spark):
    assert entry_points.entry(spark).count() == 19
