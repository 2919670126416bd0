"""Plan properties the scale design relies on."""

import re

from pyspark.sql import functions as F

import __spark_entry__ as E
from qalytics.operators import marts
from qalytics.plans import Relations
from tests.conftest import SF0001


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_dedup_reduces_map_side_and_prunes_columns(spark):
    rel = Relations(spark, SF0001)
    p = _plan(marts.tests_per_run(rel.run_test_counts))
    assert "row_number(), 1, Partial" in p
    lineitem = [s for s in re.findall(r"FileScan parquet \[([^\]]*)\]", p) if "l_orderkey" in s]
    # two of the id, run, assignee, status, stamp and tie-break
    assert lineitem and all(len(s.split(",")) <= 6 for s in lineitem)


def test_filters_reach_the_scans(spark):
    q = E.queries()
    assert "EqualTo(n_nationkey,12)" in _plan(q["mart_filter"](spark, SF0001))
    p = _plan(q["velocity_daily"](spark, SF0001))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(ts,", p)


def test_one_row_totals_are_subqueries_not_cross_joins(spark):
    q = E.queries()
    for name in ("kpi_header", "unlinked_audit", "monthly_scorecards", "sync_state_merge"):
        p = _plan(q[name](spark, SF0001))
        assert "NestedLoop" not in p and "Cartesian" not in p, name
    assert "Subquery" in _plan(q["kpi_header"](spark, SF0001))


def test_no_python_udfs_in_marts(spark):
    p = _plan(E.queries()["dashboard_mart"](spark, SF0001).select(F.col("month_key")))
    assert "EvalPython" not in p
