"""Mart semantics on hand-made frames, with values worked out by hand."""

import datetime as dt

from pyspark.sql import functions as F

from qalytics.operators import conform, marts
from tests.conftest import rows

T = dt.datetime
AS_OF = T(2024, 2, 10)


def _frames(spark):
    stg = spark.createDataFrame([
        (100, 1, "2024-01", 12), (100, 2, "2024-01", 12), (200, 3, "2024-01", 5), (None, 4, "2024-02", 12),
    ], "plan_id long, run_id long, month_key string, project_id long")
    tests = spark.createDataFrame([
        (11, 1, 1, 1, T(2024, 1, 1), 0.0), (12, 1, 2, 1, T(2024, 1, 1), 0.0), (13, 1, 3, 5, T(2024, 1, 1), 0.0),
        (21, 2, 1, 1, T(2024, 1, 1), 0.0), (22, 2, 2, 1, T(2024, 1, 1), 0.0),
        (31, 3, 1, 2, T(2024, 1, 1), 0.0),
    ], "id long, run_id long, case_id long, status_id long, _extracted_at timestamp_ntz, _tiebreak double")
    cases = spark.createDataFrame([(1, 4), (2, 3), (3, 3)], "id long, priority_id long")
    results = spark.createDataFrame([
        (1, 11, "CM-1, CM-2", '{"custom_result_acta_certificacion":"x"}'),
        (2, 12, "CM-1", '{"custom_reincidencia":true}'),
        (3, 12, "", None),
        (4, 21, None, '{"custom_result_acta_certificacion":"y"}'),
        (5, 31, "CM-3 CM-3", None),
        (6, 13, "CM-9", None),
    ], "id long, test_id long, defects string, custom_fields string")
    issues = spark.createDataFrame([
        ("CM-1", "Cerrado", "Alta", T(2024, 1, 1)), ("CM-1", "Backlog", None, T(2024, 1, 1)),
        ("CM-2", None, "Baja", T(2023, 12, 1)), ("CM-3", "Probando", "Crítica", T(2024, 2, 1)),
    ], "key string, status string, priority string, created timestamp_ntz")
    return stg, tests, cases, results, issues


def _columns(df, key, *names):
    return {r[key]: tuple(r[n] for n in names) for r in df.collect()}


def test_run_defects_jira_by_hand(spark):
    stg, tests, cases, results, issues = _frames(spark)
    got = marts.run_defects_jira(conform.result_texts(results), tests, issues, AS_OF)
    # run 1: CM-1 (twice, two snapshots) and CM-2; CM-9 is no issue. Run 3: CM-3 twice in one text.
    assert _columns(got, "run_id", *marts.JIRA_COUNTS) == {
        # count, closed, active, ready, in progress, open, critical, high, medium, low
        1: (2, 1, 1, 0, 0, 1, 0, 1, 0, 1),  # CM-2 has no status: neither closed nor active
        3: (1, 0, 1, 0, 1, 0, 1, 0, 0, 0),
    }
    ages = _columns(got, "run_id", "avg_defect_age_days")
    # CM-1 is 40 days old and met four times (two results, two snapshots), CM-2 71 days and once
    assert ages[1][0] == (4 * 40 + 71) / 5 and ages[3][0] == 9


def test_run_stats_by_hand(spark):
    stg, tests, cases, results, issues = _frames(spark)
    texts = conform.result_texts(results)
    rdp = marts.run_defects_priority(texts, tests, cases)
    rdj = marts.run_defects_jira(texts, tests, issues, AS_OF)
    assert {(r["run_id"], r["priority_id"]): (r["defects_count"], r["results_with_defects"], r["acta_count"], r["iterations_count"])
            for r in rdp.collect()} == {(1, 4): (1, 1, 1, 0), (1, 3): (3, 2, 0, 1), (2, 4): (0, 0, 1, 0), (3, 4): (1, 1, 0, 0)}
    counts = conform.run_test_counts(tests.withColumn("assignedto_id", F.lit(7)))
    names = ("passed_count", "failed_count", "total_tests", "defects_count", "total_acta_count", "iterations_count", "jira_defects_count",
             "severity_high", "is_uat_returned", "is_uat_certified", "is_uat_signed", "is_uat_in_process")
    assert _columns(marts.run_stats(stg, counts, rdp, rdj), "run_id", *names) == {
        # 3 tests, 2 priorities: counts doubled, defect sums tripled, issue sums times six
        1: (4, 2, 6, 9, 3, 3, 12, 6, 1, 0, 0, 0),
        # all passed, one certificate: signed, not certified
        2: (2, 0, 2, 0, 2, 0, 0, 0, 0, 0, 1, 0),
        3: (0, 0, 1, 1, 0, 0, 1, 0, 0, 0, 0, 0),
        # no tests
        4: (0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0),
    }
    exact = _columns(marts.run_stats(stg, counts, rdp, rdj, exact=True), "run_id", "total_tests", "defects_count", "jira_defects_count")
    assert exact[1] == (3, 3, 2)


def test_uat_returned_and_in_process_never_both(spark):
    from tests.conftest import SF001
    from qalytics.plans import Relations

    rs = Relations(spark, SF001).run_stats
    assert rs.where("is_uat_returned = 1 AND is_uat_in_process = 1").count() == 0
    assert rs.where("is_uat_certified = 1 AND is_uat_signed = 1").count() == 0
    # FIXTURES.md §3: UAT runs returned / certified / signed / in process at sf0.01
    agg = rs.where("project_id = 12").selectExpr("sum(is_uat_returned)", "sum(is_uat_certified)", "sum(is_uat_signed)",
                                                 "sum(is_uat_in_process)", "count(*)").collect()[0]
    assert tuple(agg) == (383, 111, 6, 139, 642)
    tot = rs.selectExpr("sum(total_tests)").collect()[0][0]
    exact = Relations(spark, SF001).run_stats_exact.selectExpr("sum(total_tests)").collect()[0][0]
    assert (exact, tot) == (45832, 48805)


def test_workload_applies_user_snapshot_multiplicity(spark):
    tests = spark.createDataFrame([(1, 10, 1, 7), (2, 10, 5, 7), (3, 10, 3, 8), (4, 10, 3, 0)],
                                  "id long, run_id long, status_id long, assignedto_id long")
    runs = spark.createDataFrame([(10, 4, T(2024, 1, 1))], "id long, project_id long, created_on timestamp_ntz")
    projects = spark.createDataFrame([(4, "P4", False)], "id long, name string, is_completed boolean")
    users = spark.createDataFrame([(7, "Ana"), (7, "Ana"), (7, "Ana (old)")], "id long, name string")
    tests = conform.run_test_counts(tests)
    got = rows(marts.workload_by_analyst(tests, runs, projects, users),
               "analyst_name", "total_assigned", "passed_cases", "failed_cases", "untested_cases")
    # Ana appears twice in the user table: counts doubled, distinct tests not
    assert got == [("Ana", 2, 2, 2, 0), ("Ana (old)", 2, 1, 1, 0), ("Analista #8", 1, 0, 0, 1)]
    d = marts.project_analyst_demand(tests, runs, projects, users).collect()[0]
    assert (d["analyst_count"], d["test_count"], d["analyst_names"]) == (2, 3, "Ana, Ana (old), Analista #8")
