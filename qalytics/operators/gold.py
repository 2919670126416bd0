"""Gold KPI tables over the cycle fact and the staged runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qalytics import config as C
from qalytics.functions import elapsed_days, safe_divide


def kpi_monthly_performance(fact: DataFrame) -> DataFrame:
    """Per month: distinct cycles, on-time start/end counts and rates, blocked
    cycles, mean duration in whole days.

    The distinct count is done as a two-level aggregate — first per
    (month, cycle), then per month — instead of a DISTINCT aggregate, so rows
    are not expanded and a dominant month is still reduced map-side."""
    per_cycle = fact.groupBy("month_key", "cycle_id").agg(
        F.count_if(F.col("on_time_start")).alias("s"),
        F.count_if(F.col("on_time_end")).alias("e"),
        F.count_if(F.col("is_blocked")).alias("b"),
        F.sum(elapsed_days("created_on", "completed_on")).alias("d_sum"),
        F.count(elapsed_days("created_on", "completed_on")).alias("d_n"),
    )
    m = per_cycle.groupBy("month_key").agg(
        F.count(F.lit(1)).alias("total_cycles"),
        F.sum("s").alias("on_time_start_count"),
        F.sum("e").alias("on_time_end_count"),
        F.sum("b").alias("blocked_cycles_count"),
        F.sum("d_sum").alias("d_sum"),
        F.sum("d_n").alias("d_n"),
    )
    return m.select(
        "month_key", "total_cycles", "on_time_start_count", "on_time_end_count",
        safe_divide("on_time_start_count", "total_cycles").alias("on_time_start_pct"),
        safe_divide("on_time_end_count", "total_cycles").alias("on_time_end_pct"),
        "blocked_cycles_count",
        safe_divide("d_sum", "d_n").alias("avg_cycle_duration_days"),
    )


def kpi_by_plan(fact: DataFrame) -> DataFrame:
    return fact.groupBy("plan_id", "plan_name", "month_key").agg(
        F.count("cycle_id").alias("total_runs"),
        F.count_if(F.col("is_closed")).alias("closed_runs"),
        F.sum("passed_count").alias("total_passed"),
        F.sum("failed_count").alias("total_failed"),
        F.sum("blocked_count").alias("total_blocked"),
        safe_divide(F.sum("passed_count"), F.sum("total_tests")).alias("pass_rate"),
    )


def kpi_uat_certification(fact: DataFrame) -> DataFrame:
    return fact.groupBy("month_key", "project_id").agg(
        F.count("cycle_id").alias("total_uat_cycles"),
        F.count_if(F.col("uat_certified")).alias("certified_cycles"),
        safe_divide(F.count_if(F.col("uat_certified")), F.count("cycle_id")).alias("certification_rate"),
    )


def _legacy(stg: DataFrame, key: str) -> DataFrame:
    s = stg.where(F.col(key).isNotNull() & ~F.col("project_id").isin(*C.LEGACY_KPI_EXCLUDED_PROJECTS))
    return s.groupBy(key).agg(
        F.count("run_id").alias("Runs"),
        F.sum("on_time_to_qa").alias("Inicio_a_Tiempo"),
        F.sum("on_time_from_qa").alias("Finalizacion_a_Tiempo"),
        F.sum("is_blocked").alias("Bloqueados"),
    )


def kpis_plan(stg: DataFrame) -> DataFrame:
    """Legacy per-plan-name KPIs (projects 12 and 21 left out)."""
    return _legacy(stg, "plan_name")


def kpis_mes(stg: DataFrame) -> DataFrame:
    """Legacy per-month KPIs (projects 12 and 21 left out)."""
    return _legacy(stg, "month_key")
