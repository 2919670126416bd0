"""The written medallion layers give the same relations as the lazy lineage."""

from qalytics.plans.medallion import refresh
from qalytics.plans.relations import Relations
from tests.conftest import SF0001, rows


def test_refresh_matches_lazy_lineage(spark):
    timings = {}
    m = refresh(spark, SF0001, timings=timings)
    assert set(timings) == {"bronze_land", "silver_build", "gold_build", "mart_build"}
    raw = Relations(spark, SF0001)
    for name in ("stg_runs", "fact_cycle", "kpi_monthly_performance", "dashboard_mart", "project_summary",
                 "jira_defects_summary", "velocity_daily", "data_quality"):
        assert rows(getattr(m, name)) == rows(getattr(raw, name)), name
    assert rows(m.kpi_header()) == rows(raw.kpi_header())
    assert rows(m.relation_head("mart")) == rows(raw.relation_head("mart"))


def test_strict_refresh_stops_on_failed_checks(spark):
    import pytest

    from qalytics.plans.medallion import QualityGateError

    # the fixture's dirty runs carry duplicates, future dates, negative counts
    with pytest.raises(QualityGateError, match="Duplicate Runs"):
        refresh(spark, SF0001, strict_quality=True)
