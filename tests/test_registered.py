"""Registered queries against their SQL on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as contract
from checks import oracle, queries
from checks.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="test tables are not there")
SAMPLE = [
    "s1_read_log_multiline", "s6_station_event", "s7_lifecycle_fold", "w3_dwell_pairs",
    "q07_implied_share", "q13_pick_station_hour", "q31_bay_demand", "q36_leg_by_depth",
    "q39_fleet_timeline", "q47_day_changes", "q57_utilisation_chain",
]


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_query_has_sql_that_runs(duck):
    assert set(oracle.oracle_sql()) == set(queries.queries())
    for text in oracle.oracle_sql().values():
        duck.sql(text).fetchall()


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name):
    ours = contract.queries()[name](spark, FOLDER).toPandas()
    assert difference(ours, duck.sql(contract.oracle_sql()[name]).df()) is None


def test_entry_runs(spark):
    rows = contract.entry(spark)
    assert rows.count() > 0 and rows.columns == ["op_day", "station", "hour", "completions"]


def test_no_cross_joins(spark):
    """Sparse results are completed without crossing tables."""
    for name in ("q08_picker_rate", "q35_queue_depth", "q39_fleet_timeline", "q28_stage_by_station"):
        df = contract.queries()[name](spark, FOLDER)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name
