import os

import pytest

import __spark_entry__ as entry
from tidewatch.plans import catalog
from tools import check

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    return check.connect(SF)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["event_id", "rule", "component", "threshold", "actual", "timestamp_ms", "severity"]
    assert df.count() > 0


def test_each_query_has_its_sql():
    """Queries of llm without SQL are held against brute force in their own tests, not here."""
    assert set(catalog.queries()) == set(catalog.oracles())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query_agrees_with_sql(spark, duck, name):
    rows, problems = check.compare(spark, duck, SF, name)
    assert problems == []
    assert rows > 0 or name in ("recent_events_by_type",)
