"""Relation registry: the medallion graph as lazy DataFrames.

``Relations(spark, sf_dir)`` exposes every bronze, silver, gold and mart
relation by name. Nothing runs until an action; each attribute is a logical
plan that Catalyst optimises as a whole (pruning the columns and pushing the
filters of the final query down to the parquet scans)."""

from __future__ import annotations

import datetime as _dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qalytics import config as C
from qalytics.operators import conform, gold, ingest, marts, quality, serving
from qalytics.sources.fixtures import Bronze


class Relations:
    def __init__(self, spark: SparkSession, sf_dir: str, as_of: _dt.datetime = C.DEFAULT_AS_OF,
                 bronze: Bronze | None = None):
        self.spark = spark
        self.sf_dir = sf_dir
        self.as_of = as_of
        self.bronze = bronze or Bronze(spark, sf_dir, as_of)

    def __getattr__(self, name: str) -> DataFrame:
        # bronze relations are reachable directly (rel.raw_runs, ...)
        if name.startswith("raw_") or name == "sync_state":
            return getattr(self.bronze, name)
        raise AttributeError(name)

    # written layers break ties between equal stamps by the whole row; lazy
    # queries leave them open, so that unread columns stay unread
    pinned = False

    def _newest(self, raw: DataFrame, order: tuple[str, ...] = ("_extracted_at",)) -> DataFrame:
        return conform.dedup_latest(raw, order=order, pinned=self.pinned)

    # ---------------------------------------------------------- silver
    @cached_property
    def dedup_runs(self) -> DataFrame:
        return self._newest(self.bronze.raw_runs)

    @cached_property
    def dedup_plans(self) -> DataFrame:
        return self._newest(self.bronze.raw_plans)

    @cached_property
    def dedup_milestones(self) -> DataFrame:
        return self._newest(self.bronze.raw_milestones)

    @cached_property
    def dedup_tests(self) -> DataFrame:
        return self._newest(self.bronze.raw_tests, ("_extracted_at", "_tiebreak"))

    @cached_property
    def dedup_projects(self) -> DataFrame:
        return self._newest(self.bronze.raw_projects)

    @cached_property
    def dedup_users(self) -> DataFrame:
        return self._newest(self.bronze.raw_users)

    @cached_property
    def dedup_cases(self) -> DataFrame:
        return self._newest(self.bronze.raw_cases)

    @cached_property
    def dedup_suites(self) -> DataFrame:
        return self._newest(self.bronze.raw_suites)

    @cached_property
    def plan_max_dates(self) -> DataFrame:
        return conform.plan_max_dates(self.dedup_runs)

    @cached_property
    def stg_runs(self) -> DataFrame:
        return conform.stg_runs(self.dedup_runs, self.dedup_plans, self.dedup_milestones)

    @cached_property
    def fact_cycle(self) -> DataFrame:
        return conform.fact_cycle(self.bronze.raw_runs, self.bronze.raw_plans)

    @cached_property
    def run_test_counts(self) -> DataFrame:
        return conform.run_test_counts(self.dedup_tests)

    @cached_property
    def result_texts(self) -> DataFrame:
        return conform.result_texts(self.bronze.raw_results)

    @cached_property
    def defect_keys(self) -> DataFrame:
        return conform.defect_keys(self.bronze.raw_results)

    # ---------------------------------------------------------- gold
    @cached_property
    def kpi_monthly_performance(self) -> DataFrame:
        return gold.kpi_monthly_performance(self.fact_cycle)

    @cached_property
    def kpi_by_plan(self) -> DataFrame:
        return gold.kpi_by_plan(self.fact_cycle)

    @cached_property
    def kpi_uat_certification(self) -> DataFrame:
        return gold.kpi_uat_certification(self.fact_cycle)

    @cached_property
    def kpis_plan(self) -> DataFrame:
        return gold.kpis_plan(self.stg_runs)

    @cached_property
    def kpis_mes(self) -> DataFrame:
        return gold.kpis_mes(self.stg_runs)

    # ---------------------------------------------------------- quality
    @cached_property
    def data_quality(self) -> DataFrame:
        return quality.data_quality(self.bronze.raw_runs_dirty, self.dirty_fact, self.as_of)

    @cached_property
    def dirty_fact(self) -> DataFrame:
        """The cycle fact of the runs that the checks look at."""
        return conform.fact_cycle(self.bronze.raw_runs_dirty, self.bronze.raw_plans)

    # ---------------------------------------------------------- marts
    @cached_property
    def stg_runs_wide(self) -> DataFrame:
        return conform.stg_runs_wide(self.dedup_runs, self.dedup_plans, self.dedup_milestones)

    @cached_property
    def run_defects_priority(self) -> DataFrame:
        return marts.run_defects_priority(self.result_texts, self.dedup_tests, self.bronze.raw_cases)

    @cached_property
    def run_defects_jira(self) -> DataFrame:
        return marts.run_defects_jira(self.result_texts, self.dedup_tests, self.bronze.raw_jira_issues, self.as_of)

    @cached_property
    def run_stats(self) -> DataFrame:
        return marts.run_stats(self.stg_runs, self.run_test_counts, self.run_defects_priority, self.run_defects_jira)

    @cached_property
    def run_stats_exact(self) -> DataFrame:
        return marts.run_stats(self.stg_runs, self.run_test_counts, self.run_defects_priority, self.run_defects_jira,
                               exact=True)

    @cached_property
    def plan_aggs(self) -> DataFrame:
        wide = self.stg_runs_wide
        run_level = marts.run_stats(wide, self.run_test_counts, self.run_defects_priority, self.run_defects_jira,
                                    keep=tuple(wide.columns))
        return marts.plan_aggs(run_level, self.dedup_projects, self.bronze.raw_users)

    @cached_property
    def dashboard_mart(self) -> DataFrame:
        return marts.dashboard_mart(self.plan_aggs)

    @cached_property
    def run_stats_priority(self) -> DataFrame:
        stg = self.stg_runs.where(F.col("project_id").isin(*marts.VALIDATION_PROJECTS))
        return marts.run_stats(stg, self.run_test_counts, self.run_defects_priority, None, priority_breakdown=True)

    @cached_property
    def pruebas_plan_aggs(self) -> DataFrame:
        wide = self.stg_runs_wide.where(F.col("project_id").isin(*marts.VALIDATION_PROJECTS))
        run_level = marts.run_stats(wide, self.run_test_counts, self.run_defects_priority, None,
                                    priority_breakdown=True, keep=tuple(wide.columns))
        return marts.pruebas_plan_aggs(run_level, self.bronze.raw_users)

    @cached_property
    def dashboard_pruebas(self) -> DataFrame:
        return marts.dashboard_pruebas(self.pruebas_plan_aggs)

    @cached_property
    def active_plans(self) -> DataFrame:
        return marts.active_plans(self.dedup_plans)

    @cached_property
    def repo_cases(self) -> DataFrame:
        return marts.repo_cases(self.dedup_cases, self.dedup_suites)

    @cached_property
    def exec_stats(self) -> DataFrame:
        return marts.exec_stats(self.dashboard_mart)

    @cached_property
    def project_analysts(self) -> DataFrame:
        return marts.project_analysts(self.dedup_runs, self.dedup_users)

    @cached_property
    def project_summary(self) -> DataFrame:
        return marts.project_summary(self.dedup_projects, self.active_plans, self.repo_cases, self.exec_stats,
                                     self.project_analysts)

    @cached_property
    def workload_by_analyst(self) -> DataFrame:
        return marts.workload_by_analyst(self.run_test_counts, self.dedup_runs, self.dedup_projects, self.bronze.raw_users)

    @cached_property
    def project_analyst_demand(self) -> DataFrame:
        return marts.project_analyst_demand(self.run_test_counts, self.dedup_runs, self.dedup_projects,
                                            self.bronze.raw_users)

    @cached_property
    def linked_info(self) -> DataFrame:
        return marts.linked_info(self.result_texts, self.dedup_tests, self.stg_runs, self.bronze.raw_projects)

    @cached_property
    def jira_defects_summary(self) -> DataFrame:
        return marts.jira_defects_summary(self.bronze.raw_jira_issues, self.linked_info, self.as_of)

    # ---------------------------------------------------------- serving (§2.D)
    def relation_head(self, kind: str | None = "mart") -> DataFrame:
        return serving.relation_head(self, kind)

    @cached_property
    def project_summary_top(self) -> DataFrame:
        return serving.project_summary_top(self.project_summary)

    @cached_property
    def velocity_daily(self) -> DataFrame:
        return serving.velocity_daily(self.bronze.raw_results, self.as_of)

    @cached_property
    def automation_coverage(self) -> DataFrame:
        return serving.automation_coverage(self.bronze.raw_cases)

    @cached_property
    def defect_aging_top5(self) -> DataFrame:
        return serving.defect_aging_top(self.bronze.raw_jira_issues, self.as_of)

    @cached_property
    def fact_scorecards(self) -> DataFrame:
        return serving.fact_scorecards(self.fact_cycle)

    @cached_property
    def monthly_scorecards(self) -> DataFrame:
        return serving.monthly_scorecards(self.kpi_monthly_performance)

    # ---------------------------------------------------------- dashboard steps (§2.E)
    @cached_property
    def filter_options(self) -> DataFrame:
        return serving.filter_options(self.dashboard_mart)

    def mart_filter(self, month: str | None = "All", project: str | int | None = "All") -> DataFrame:
        return serving.mart_filter(self.dashboard_mart, month, project)

    def kpi_header(self, month: str | None = "All", project: str | int | None = "All") -> DataFrame:
        return serving.kpi_header(self.mart_filter(month, project), self.jira_defects_summary)

    def status_breakdown(self, month: str | None = "All", project: str | int | None = "All") -> DataFrame:
        return serving.status_breakdown(self.mart_filter(month, project))

    def status_pie(self, month: str | None = "All", project: str | int | None = "All") -> DataFrame:
        return serving.status_pie(self.mart_filter(month, project))

    @cached_property
    def defects_by_severity(self) -> DataFrame:
        return serving.defects_by_severity(self.jira_defects_summary)

    @cached_property
    def defects_by_status(self) -> DataFrame:
        return serving.defects_by_status(self.jira_defects_summary)

    @cached_property
    def automation_pct(self) -> DataFrame:
        return serving.automation_pct(self.automation_coverage)

    @cached_property
    def project_names(self) -> list[str]:
        """Names in the project dimension: the pivots' columns."""
        named = self.dedup_projects.where("name IS NOT NULL").select("name").distinct().orderBy("name")
        return [r["name"] for r in named.collect()]

    @cached_property
    def workload_pivot(self) -> DataFrame:
        return serving.workload_pivot(self.workload_by_analyst, self.project_names)

    @cached_property
    def workload_detail(self) -> DataFrame:
        return serving.workload_detail(self.workload_by_analyst)

    @cached_property
    def demand_years(self) -> DataFrame:
        return serving.demand_years(self.project_analyst_demand)

    @cached_property
    def demand_pivot(self) -> DataFrame:
        return serving.demand_pivot(self.project_analyst_demand, self.project_names)

    @cached_property
    def demand_detail(self) -> DataFrame:
        return serving.demand_detail(self.project_analyst_demand)

    @cached_property
    def demand_scatter(self) -> DataFrame:
        return serving.demand_scatter(self.project_analyst_demand)

    @cached_property
    def unlinked_audit(self) -> DataFrame:
        return serving.unlinked_audit(self.jira_defects_summary)

    @cached_property
    def execution_detail(self) -> DataFrame:
        return serving.execution_detail(self.dashboard_mart)

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name)

    # ---------------------------------------------------------- ingest (§2.A)
    @cached_property
    def landed(self):
        from qalytics.sources.landed import Landed
        return Landed(self.bronze)

    @cached_property
    def bronze_append(self) -> DataFrame:
        return ingest.bronze_append(self.landed.runs, "raw_runs", self.as_of)

    @cached_property
    def epoch_normalize(self) -> DataFrame:
        return ingest.epoch_normalize(self.landed.runs.select("id", "created_on", "completed_on"))

    @cached_property
    def json_stringify(self) -> DataFrame:
        return ingest.json_stringify(self.landed.runs.select("id", "custom_status_count"))

    @cached_property
    def collect_custom_fields(self) -> DataFrame:
        return ingest.collect_custom_fields(self.landed.result_records).select("id", "custom_fields")

    @cached_property
    def explode_plan_entries(self) -> DataFrame:
        return ingest.bronze_append(ingest.explode_plan_entries(self.landed.plan_docs), "raw_runs", self.as_of)

    @cached_property
    def plan_documents(self) -> DataFrame:
        plans = ingest.bronze_append(ingest.document_records(self.landed.plan_docs, "raw_plans"), "raw_plans", self.as_of)
        return plans.withColumn("entries", F.json_array_length("entries"))

    @cached_property
    def milestone_documents(self) -> DataFrame:
        return ingest.bronze_append(ingest.document_records(self.landed.milestone_docs, "raw_milestones"), "raw_milestones", self.as_of)

    @cached_property
    def cases_from_pages(self) -> DataFrame:
        return ingest.cases_from_pages(self.landed.case_pages).select("id", "project_id", "suite_id", "priority_id", "is_deleted")

    @cached_property
    def skipped_pages(self) -> DataFrame:
        return ingest.skipped_pages(self.landed.case_pages).select("project_id", "suite_id", "page", "reason")

    @cached_property
    def stamp_parent(self) -> DataFrame:
        cases = self.bronze.raw_cases.select("id", "suite_id", "priority_id")
        return ingest.stamp_parent(cases, self.dedup_suites, "suite_id")

    @cached_property
    def cases_by_suite_mode(self) -> DataFrame:
        return ingest.cases_by_suite_mode(self.bronze.raw_cases, self.dedup_suites, self.dedup_projects)

    @cached_property
    def scoped_runs(self) -> DataFrame:
        return ingest.scoped_runs(self.bronze.raw_runs)

    @cached_property
    def watermark_read(self) -> DataFrame:
        scopes = self.dedup_projects.select(F.col("id").alias("project_id"))
        return ingest.watermark_read(self.bronze.sync_state, "runs", scopes, "project_id")

    @cached_property
    def incremental_extract(self) -> DataFrame:
        return ingest.incremental_extract(self.landed_runs_bronze, self.bronze.sync_state, "runs")

    @cached_property
    def landed_runs_bronze(self) -> DataFrame:
        return ingest.bronze_append(self.landed.runs, "raw_runs", self.as_of)

    @cached_property
    def watermark_advance(self) -> DataFrame:
        return ingest.watermark_advance(self.incremental_extract, self.bronze.sync_state, "runs", self.as_of)

    @cached_property
    def sync_state_updates(self) -> DataFrame:
        issues = ingest.watermark_advance_unscoped(
            self.bronze.raw_jira_issues.select(F.col("updated").alias("created_on")),
            self.bronze.sync_state, "jira_issues", self.as_of)
        return self.watermark_advance.unionByName(issues)

    @cached_property
    def sync_state_merge(self) -> DataFrame:
        return ingest.sync_state_merge(self.bronze.sync_state, self.sync_state_updates)

    @cached_property
    def sync_state_report(self) -> DataFrame:
        return ingest.sync_state_report(self.sync_state_merge)

    @cached_property
    def issue_flatten(self) -> DataFrame:
        from qalytics.sources.landed import TRACKER_URL
        return ingest.issue_flatten(self.landed.issue_docs, TRACKER_URL)

    @cached_property
    def snapshot_load(self) -> DataFrame:
        n = self.bronze.table("nation")
        pulled = n.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"),
                          (F.col("n_nationkey") % 5 == 4).alias("is_completed"),
                          (1 + F.col("n_nationkey") % 3).cast("long").alias("suite_mode"))
        landed = ingest.bronze_append(pulled, "raw_projects", self.as_of).select(*self.bronze.raw_projects.columns)
        return self.bronze.raw_projects.unionByName(landed)

    def _snapshot(self, entity: str, pulled: DataFrame) -> DataFrame:
        """The bronze table of ``entity`` after a full re-pull."""
        held = getattr(self.bronze, entity)
        landed = ingest.bronze_append(pulled, entity, self.as_of)
        return held.unionByName(landed.select(*dict.fromkeys((*held.columns, "_extracted_at"))), allowMissingColumns=True)

    @cached_property
    def snapshot_load_statuses(self) -> DataFrame:
        # the rows held carry no load stamp
        return self._snapshot("raw_statuses", self.bronze.raw_statuses)

    @cached_property
    def snapshot_load_users(self) -> DataFrame:
        s = self.bronze.table("supplier").where(F.col("s_suppkey") % 7 != 3)
        return self._snapshot("raw_users", s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))

    @cached_property
    def snapshot_load_suites(self) -> DataFrame:
        # upstream, brands got a new name and suite 11 was deleted
        p = self.bronze.table("part")
        suite = F.substr(F.col("p_brand"), F.lit(7)).cast("long")
        pulled = p.where(suite != 11).select(suite.alias("id"), (suite % 25).alias("project_id"), F.upper("p_brand").alias("name"))
        return self._snapshot("raw_suites", pulled.distinct())

    @cached_property
    def snapshot_load_milestones(self) -> DataFrame:
        return self._snapshot("raw_milestones", ingest.document_records(self.landed.milestone_docs, "raw_milestones"))

    @cached_property
    def ingest_counts(self) -> DataFrame:
        b = self.bronze
        return ingest.ingest_counts({
            "projects": b.raw_projects, "users": b.raw_users, "milestones": b.raw_milestones, "plans": b.raw_plans,
            "runs": b.raw_runs, "suites": b.raw_suites, "cases": b.raw_cases, "tests": b.raw_tests,
            "jira_issues": b.raw_jira_issues,
        })

    @cached_property
    def ingest_counts_all(self) -> DataFrame:
        """All 11 entities: results and statuses get their stamp as they land."""
        b = self.bronze
        return self.ingest_counts.unionByName(ingest.ingest_counts({
            "results": ingest.bronze_append(b.raw_results, "raw_results", self.as_of),
            "statuses": ingest.bronze_append(b.raw_statuses, "raw_statuses", self.as_of),
        }))
