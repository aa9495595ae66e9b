"""Every registered query against its SQL twin, and the shape of its plan."""

import pytest

import __spark_entry__ as entry_point
import check_queries
from panelwatch.plans.catalog import REGISTRY

ORACLE = entry_point.oracle_sql()
CHECKED = [n for n in REGISTRY if n in ORACLE]


@pytest.fixture(scope="module")
def con(data):
    return check_queries.connect(data)


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, data, con, name):
    line = check_queries.compare(spark, con, name, entry_point.queries()[name], ORACLE[name], data)
    assert line.startswith("OK"), line


def test_only_file_names_lack_sql():
    assert set(REGISTRY) <= set(entry_point.queries())
    assert set(REGISTRY) - set(ORACLE) == {"hsh1_file_hash"}


@pytest.mark.parametrize("name", [
    "qry1_latest_risk", "qry6_risk_at_points", "idx5_index_daily", "idx6_index_monthly", "agg4_exact_median",
    "win10_dense_panel", "joi7_box_join", "joi8_nearest_center", "joi9_point_in_polygon", "grf1_adjacency",
    "qry3_forecast", "stmc_recent_reports",
])
def test_plan_has_no_all_pairs_join_and_no_python(spark, data, name):
    plan = entry_point.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ArrowEval"):
        assert word not in plan


def test_scans_read_only_needed_columns(spark, data):
    from panelwatch.sources.standins import Standins

    plan = Standins(spark, data).weather()._jdf.queryExecution().executedPlan().toString()
    assert "l_quantity" in plan and "l_extendedprice" not in plan and "o_totalprice" not in plan


def test_top_rows_are_limited_before_the_shuffle(spark, data):
    for name in ("stmb_badge_awards", "stmc_recent_reports", "win8_last_rows"):
        plan = entry_point.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "WindowGroupLimit" in plan and ", Partial" in plan


def test_entry(spark, data):
    rows = entry_point.entry(spark).collect()
    assert rows and all(r.risk_level in ("Low", "Moderate", "High", "Very High") for r in rows)
