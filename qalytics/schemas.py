"""Declared bronze schemas (all nullable except ids), including the columns
the SQL uses but the declared schemas lack (runs.assignedto_id, issue
reporter / resolution, raw_users)."""

from __future__ import annotations

from pyspark.sql import types as T

L, S, B, TS = T.LongType(), T.StringType(), T.BooleanType(), T.TimestampNTZType()


def _schema(*fields: tuple[str, T.DataType], required: tuple[str, ...] = ("id",)) -> T.StructType:
    return T.StructType([T.StructField(n, t, n not in required) for n, t in fields])


AUDIT = (("_extracted_at", TS), ("_source", S))

RAW_PROJECTS = _schema(("id", L), ("name", S), ("announcement", S), ("show_announcement", B), ("is_completed", B),
                       ("completed_on", TS), ("suite_mode", L), ("url", S), *AUDIT)
RAW_USERS = _schema(("id", L), ("name", S), ("_extracted_at", TS))
RAW_STATUSES = _schema(("id", L), ("name", S), ("label", S), ("color_dark", L), ("color_medium", L),
                       ("color_bright", L), ("is_system", B), ("is_untested", B), ("is_final", B), *AUDIT)
RAW_MILESTONES = _schema(("id", L), ("project_id", L), ("name", S), ("description", S), ("due_on", TS),
                         ("is_completed", B), ("completed_on", TS), ("url", S), ("custom_fields", S), *AUDIT)
RAW_PLANS = _schema(("id", L), ("project_id", L), ("milestone_id", L), ("name", S), ("description", S),
                    ("is_completed", B), ("completed_on", TS), ("created_on", TS), ("created_by", L),
                    ("entries", S), ("url", S), ("custom_fields", S), *AUDIT)
RAW_RUNS = _schema(("id", L), ("project_id", L), ("milestone_id", L), ("plan_id", L), ("suite_id", L), ("name", S),
                   ("description", S), ("config", S), ("is_completed", B), ("completed_on", TS),
                   ("passed_count", L), ("blocked_count", L), ("untested_count", L), ("retest_count", L),
                   ("failed_count", L), ("custom_status_count", S), ("created_on", TS), ("created_by", L),
                   ("url", S), ("updated_on", TS), ("assignedto_id", L), *AUDIT)
RAW_SUITES = _schema(("id", L), ("name", S), ("description", S), ("project_id", L), ("is_master", B),
                     ("is_baseline", B), ("is_completed", B), ("completed_on", TS), ("url", S), *AUDIT)
RAW_CASES = _schema(("id", L), ("title", S), ("section_id", L), ("template_id", L), ("type_id", L),
                    ("priority_id", L), ("milestone_id", L), ("refs", S), ("created_by", L), ("created_on", TS),
                    ("updated_by", L), ("updated_on", TS), ("estimate", S), ("estimate_forecast", S),
                    ("suite_id", L), ("display_order", L), ("is_deleted", L), ("custom_status", L),
                    ("custom_automation_type", L), *AUDIT)
RAW_TESTS = _schema(("id", L), ("case_id", L), ("run_id", L), ("status_id", L), ("assignedto_id", L), ("title", S),
                    ("template_id", L), ("type_id", L), ("priority_id", L), ("estimate", S),
                    ("estimate_forecast", S), ("refs", S), ("milestone_id", L), ("custom_status", L),
                    ("custom_automation_type", L), *AUDIT)
RAW_RESULTS = _schema(("id", L), ("test_id", L), ("status_id", L), ("created_on", TS), ("created_by", L),
                      ("defects", S), ("elapsed", S), ("comment", S), ("version", S), ("custom_fields", S), *AUDIT)
RAW_JIRA_ISSUES = _schema(("id", S), ("key", S), ("summary", S), ("status", S), ("priority", S), ("created", TS),
                          ("updated", TS), ("assignee", S), ("url", S), ("reporter", S), ("resolution", S),
                          ("_extracted_at", TS), ("_source", S), required=("id", "key"))
SYNC_STATE = _schema(("entity_type", S), ("scope_id", S), ("last_updated_at_watermark", L),
                     ("last_sync_ts", TS), ("status", S), required=("entity_type",))

BRONZE = {
    "raw_projects": RAW_PROJECTS,
    "raw_users": RAW_USERS,
    "raw_statuses": RAW_STATUSES,
    "raw_milestones": RAW_MILESTONES,
    "raw_plans": RAW_PLANS,
    "raw_runs": RAW_RUNS,
    "raw_suites": RAW_SUITES,
    "raw_cases": RAW_CASES,
    "raw_tests": RAW_TESTS,
    "raw_results": RAW_RESULTS,
    "raw_jira_issues": RAW_JIRA_ISSUES,
}

# Landed timestamp columns that may arrive as epoch seconds.
EPOCH_COLUMNS = ("created_on", "completed_on", "updated_on", "due_on")
