"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import Oracle, compare

SF_DIR = os.environ.get("TEST_SF_DIR", entry.SMOKE_DIR)
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables here")


@pytest.fixture(scope="module")
def oracle():
    return Oracle(SF_DIR)


def test_flagship(spark):
    assert entry.entry(spark).count() == 10


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", entry.queries())
def test_query(spark, oracle, name):
    frame = entry.queries()[name](spark, SF_DIR).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is not None:
        assert compare(frame, oracle.run(sql)) is None


def test_counts_published_for_the_tables(spark):
    rows = entry.queries()["compare_summary"](spark, SF_DIR).filter("target = '/b'").first()
    names = ("identical", "different", "only_in_master", "only_in_target", "moved")
    assert tuple(rows[name] for name in names) == (143, 16, 29, 10, 12)
    assert entry.queries()["tree_reclaimable"](spark, SF_DIR).count() == 58
