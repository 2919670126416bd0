"""Registered queries: name → callable(spark, sf_dir) → DataFrame.

Each query builds the relation graph over the given tables and returns the
named relation lazily; the caller decides the action."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from qalytics.operators import quality
from qalytics.plans.relations import Relations

QueryFn = Callable[[SparkSession, str], DataFrame]


def _rel(attr: str) -> QueryFn:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(Relations(spark, sf_dir), attr)
    run.__name__ = attr
    return run


def _call(attr: str, *args) -> QueryFn:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(Relations(spark, sf_dir), attr)(*args)
    run.__name__ = attr
    return run


def _dq(check: str) -> QueryFn:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rel = Relations(spark, sf_dir)
        runs = rel.raw_runs_dirty
        if check == "dq_duplicate_runs":
            return quality.dq_duplicate_runs(runs)
        if check == "dq_future_dates":
            return quality.dq_future_dates(runs, rel.as_of)
        if check == "dq_negative_counts":
            return quality.dq_negative_counts(runs)
        return quality.dq_start_after_end(rel.dirty_fact)
    run.__name__ = check
    return run


def streaming_query(name: str) -> QueryFn:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from qalytics.plans import streams
        return getattr(streams, name)(Relations(spark, sf_dir))
    run.__name__ = name
    return run


def landing_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land all bronze tables; rows per entity as the writes counted them."""
    from qalytics.plans import medallion
    from qalytics.session import fresh_shared_path

    root = fresh_shared_path(spark, "landing")
    medallion.land_bronze(Relations(spark, sf_dir), root)
    return medallion.audit(spark, root).where("entity <> 'runs_dirty'").select("entity", "rows")


QUERIES: dict[str, QueryFn] = {
    # §2.A ingest
    "bronze_append": _rel("bronze_append"),
    "epoch_normalize": _rel("epoch_normalize"),
    "json_stringify": _rel("json_stringify"),
    "collect_custom_fields": _rel("collect_custom_fields"),
    "explode_plan_entries": _rel("explode_plan_entries"),
    "plan_documents": _rel("plan_documents"),
    "milestone_documents": _rel("milestone_documents"),
    "stamp_parent": _rel("stamp_parent"),
    "cases_by_suite_mode": _rel("cases_by_suite_mode"),
    "cases_from_pages": _rel("cases_from_pages"),
    "skipped_pages": _rel("skipped_pages"),
    "scoped_runs": _rel("scoped_runs"),
    "watermark_read": _rel("watermark_read"),
    "incremental_extract": _rel("incremental_extract"),
    "watermark_advance": _rel("watermark_advance"),
    "sync_state_merge": _rel("sync_state_merge"),
    "sync_state_report": _rel("sync_state_report"),
    "issue_flatten": _rel("issue_flatten"),
    "issue_microbatch": streaming_query("issue_microbatch"),
    "velocity_stream": streaming_query("velocity_stream"),
    "snapshot_load": _rel("snapshot_load"),
    "snapshot_load_statuses": _rel("snapshot_load_statuses"),
    "snapshot_load_users": _rel("snapshot_load_users"),
    "snapshot_load_suites": _rel("snapshot_load_suites"),
    "snapshot_load_milestones": _rel("snapshot_load_milestones"),
    "ingest_counts": _rel("ingest_counts"),
    "ingest_counts_all": _rel("ingest_counts_all"),
    "landing_audit": landing_audit,
    # §2.B conformance
    "run_test_counts": _rel("run_test_counts"),
    "result_texts": _rel("result_texts"),
    "dedup_latest": _rel("dedup_tests"),
    "dedup_latest_stream": streaming_query("dedup_latest_stream"),
    "plan_max_dates": _rel("plan_max_dates"),
    "stg_runs": _rel("stg_runs"),
    "fact_cycle": _rel("fact_cycle"),
    "defect_keys": _rel("defect_keys"),
    # §2.C gold
    "kpi_monthly_performance": _rel("kpi_monthly_performance"),
    "kpi_by_plan": _rel("kpi_by_plan"),
    "kpi_uat_certification": _rel("kpi_uat_certification"),
    "kpis_plan": _rel("kpis_plan"),
    "kpis_mes": _rel("kpis_mes"),
    # §2.C marts
    "run_defects_priority": _rel("run_defects_priority"),
    "run_defects_jira": _rel("run_defects_jira"),
    "run_stats": _rel("run_stats"),
    "run_stats_exact": _rel("run_stats_exact"),
    "plan_aggs": _rel("plan_aggs"),
    "dashboard_mart": _rel("dashboard_mart"),
    "run_stats_priority": _rel("run_stats_priority"),
    "dashboard_pruebas": _rel("dashboard_pruebas"),
    "active_plans": _rel("active_plans"),
    "repo_cases": _rel("repo_cases"),
    "exec_stats": _rel("exec_stats"),
    "project_analysts": _rel("project_analysts"),
    "project_summary": _rel("project_summary"),
    "workload_by_analyst": _rel("workload_by_analyst"),
    "project_analyst_demand": _rel("project_analyst_demand"),
    "linked_info": _rel("linked_info"),
    "jira_defects_summary": _rel("jira_defects_summary"),
    # §2.D serving
    "relation_head": _call("relation_head", "mart"),
    "project_summary_top": _rel("project_summary_top"),
    "velocity_daily": _rel("velocity_daily"),
    "automation_coverage": _rel("automation_coverage"),
    "defect_aging_top5": _rel("defect_aging_top5"),
    "fact_scorecards": _rel("fact_scorecards"),
    "monthly_scorecards": _rel("monthly_scorecards"),
    # §2.E dashboard steps
    "filter_options": _rel("filter_options"),
    "mart_filter": _call("mart_filter", "All", "12"),
    "kpi_header": _call("kpi_header", "All", "All"),
    "status_breakdown": _call("status_breakdown", "All", "All"),
    "status_pie": _call("status_pie", "All", "All"),
    "defects_by_severity": _rel("defects_by_severity"),
    "defects_by_status": _rel("defects_by_status"),
    "automation_pct": _rel("automation_pct"),
    "workload_pivot": _rel("workload_pivot"),
    "workload_detail": _rel("workload_detail"),
    "demand_years": _rel("demand_years"),
    "demand_pivot": _rel("demand_pivot"),
    "demand_detail": _rel("demand_detail"),
    "demand_scatter": _rel("demand_scatter"),
    "unlinked_audit": _rel("unlinked_audit"),
    "execution_detail": _rel("execution_detail"),
    # §2.F quality
    "dq_duplicate_runs": _dq("dq_duplicate_runs"),
    "dq_future_dates": _dq("dq_future_dates"),
    "dq_negative_counts": _dq("dq_negative_counts"),
    "dq_start_after_end": _dq("dq_start_after_end"),
    "data_quality": _rel("data_quality"),
}

# SURVEY §2 sub-rows (↳): each is a set of columns of its parent relation,
# registered as its own projection so it is checked on its own.
_MART_KEYS = ("month_key", "plan_id", "Iniciativa", "project_id", "project_name")
_PLAN_KEYS = ("plan_id", "plan_name", "month_key", "project_id", "project_name", "acta_certificacion")
SUB_VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "stg_acta": ("stg_runs", ("run_id", "acta_certificacion")),
    "stg_effective_dates": ("stg_runs", ("run_id", "eff_plan_start_on", "eff_plan_due_on")),
    "stg_on_time_to_qa": ("stg_runs", ("run_id", "on_time_to_qa")),
    "stg_on_time_from_qa": ("stg_runs", ("run_id", "on_time_from_qa")),
    "stg_is_blocked": ("stg_runs", ("run_id", "is_blocked")),
    "stg_is_last_cycle": ("stg_runs", ("run_id", "is_last_cycle")),
    "stg_start_deviation": ("stg_runs", ("run_id", "desviacion_inicio")),
    "stg_month_key": ("stg_runs", ("run_id", "month_key")),
    "fact_gated_counts": ("fact_cycle", ("cycle_id", "project_id", "passed_count", "failed_count", "blocked_count", "total_tests")),
    "fact_on_time_end": ("fact_cycle", ("cycle_id", "project_id", "on_time_end")),
    "fact_flags": ("fact_cycle", ("cycle_id", "project_id", "on_time_start", "is_blocked", "uat_certified")),
    "uat_returned": ("run_stats", ("run_id", "project_id", "is_uat_returned")),
    "uat_certified": ("run_stats", ("run_id", "project_id", "is_uat_certified")),
    "uat_signed": ("run_stats", ("run_id", "project_id", "is_uat_signed")),
    "uat_in_process": ("run_stats", ("run_id", "project_id", "is_uat_in_process")),
    "plan_key_fallback": ("plan_aggs", _PLAN_KEYS),
    "plan_completion_dates": ("plan_aggs", _PLAN_KEYS + ("plan_is_completed", "plan_start_date", "plan_due_date")),
    "active_defects_proxy": ("plan_aggs", _PLAN_KEYS + ("active_defects_proxy",)),
    "plan_on_time": ("plan_aggs", _PLAN_KEYS + ("on_time_to_qa_count", "on_time_from_qa_count", "total_runs", "avg_desviacion_inicio")),
    "plan_analysts": ("plan_aggs", _PLAN_KEYS + ("analysts",)),
    "mart_estado": ("dashboard_mart", _MART_KEYS + ("Estado_Iniciativa", "is_certified", "is_in_process")),
    "mart_on_time_rates": ("dashboard_mart", _MART_KEYS + ("on_time_to_qa_rate", "on_time_from_qa_rate")),
    "mart_automation": ("dashboard_mart", _MART_KEYS + ("automation_passed", "automation_total")),
    "mart_uat_metrics": ("dashboard_mart", _MART_KEYS + (
        "Soluciones_Devueltas_UAT", "Soluciones_Certificadas_UAT", "Iniciativas_Firmadas_UAT", "Soluciones_En_Proceso_UAT",
        "Iteraciones_UAT", "Soluciones_Aceptadas_General")),
    "mart_defects": ("dashboard_mart", _MART_KEYS + (
        "Total_Defectos", "Defectos_Activos", "Defectos_Cerrados", "total_defects_critical", "total_defects_high",
        "total_defects_medium", "total_defects_low", "total_status_ready", "total_status_in_progress",
        "total_status_open", "Promedio_Dias_Defecto")),
    "mart_execution": ("dashboard_mart", _MART_KEYS + ("total_returned_cases", "total_in_process", "total_blocked",
                                                       "total_untested")),
}


def _sub(attr: str, cols: tuple[str, ...]) -> QueryFn:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(Relations(spark, sf_dir), attr).select(*cols)
    run.__name__ = attr
    return run


def _scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from qalytics.operators.marts import mart_scope

    rel = Relations(spark, sf_dir)
    proj = rel.dedup_projects.select(F.col("id").alias("proj_id"), F.col("is_completed").alias("project_is_completed"))
    return rel.stg_runs.join(proj, F.col("project_id") == F.col("proj_id")).where(mart_scope()).select("run_id", "project_id")


for _k, (_attr, _cols) in SUB_VIEWS.items():
    QUERIES[_k] = _sub(_attr, _cols)
QUERIES["mart_scope_filter"] = _scope
