"""Every registered query of the fleet operators against its SQL; the document queries have tests of their own."""

import pytest
from compare import differences, duck

import __spark_entry__ as entry
from fleetlens.plans.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    assert differences(QUERIES[name](spark, FOLDER), con, ORACLES[name]) is None


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["site", "total", "online"]
    assert df.count() > 0
