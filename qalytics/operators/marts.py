"""Dashboard marts (§2.C): per-run defect and status statistics, plan
aggregates, the dashboard mart and its validation clone, the project
summary, analyst workload and demand, and the tracker-issue audit.

Pattern used throughout: aggregate the large fact tables (results, tests)
down to one row per run / (run, key) *before* joining them with anything
that could multiply rows, then reproduce the reference's join multiplicities
arithmetically. Hot keys are therefore reduced map-side by partial
aggregation, and no join ever materialises a per-run cross product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qalytics import config as C
from qalytics.functions import elapsed_days, json_object, json_value_in, listagg_distinct, safe_divide, ts_lit

STATUS_COLUMNS = {
    "passed_count": C.STATUS_PASSED,
    "blocked_count": C.STATUS_BLOCKED,
    "retest_count": C.STATUS_RETEST,
    "failed_count": C.STATUS_FAILED,
    "process_count": C.STATUS_IN_PROCESS,
    "untested_count": C.STATUS_UNTESTED,
}
JIRA_COUNTS = ("jira_defects_count", "jira_defects_closed", "jira_defects_active", "status_ready",
               "status_in_progress", "status_open", "severity_critical", "severity_high", "severity_medium",
               "severity_low")


def _i(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


# ------------------------------------------------------------ run_defects_priority
def result_tests(results: DataFrame, dedup_tests: DataFrame) -> DataFrame:
    """Results (or their summaries) with their test's run and case (inner join
    on test id)."""
    t = dedup_tests.select(F.col("id").alias("t_id"), "run_id", "case_id")
    return results.join(t, F.col("test_id") == F.col("t_id"))


def run_defects_priority(texts: DataFrame, dedup_tests: DataFrame, raw_cases: DataFrame) -> DataFrame:
    """Per (run, case priority): distinct defect texts, results with defects,
    certificate count and iteration count.

    ``texts`` are the results summed per (test, defect text): a test holding a
    large share of the results arrives at the join as one row per distinct
    text, and the counts are carried as sums through the joins."""
    cases = raw_cases.select(F.col("id").alias("c_id"), "priority_id")
    r = result_tests(texts.select("test_id", "defects", "rwd", "acta", "iters"), dedup_tests)
    r = r.join(cases, F.col("case_id") == F.col("c_id"))
    # level 1: per distinct defect text (replaces COUNT(DISTINCT defects))
    lvl1 = r.groupBy("run_id", "priority_id", "defects").agg(
        F.sum("rwd").alias("rwd"), F.sum("acta").alias("acta"), F.sum("iters").alias("iters"))
    return lvl1.groupBy("run_id", "priority_id").agg(
        F.count("defects").alias("defects_count"),
        F.sum("rwd").alias("results_with_defects"),
        F.sum("acta").alias("acta_count"),
        F.sum("iters").alias("iterations_count"),
    )


# ------------------------------------------------------------ run_defects_jira
def text_keys(texts: DataFrame) -> DataFrame:
    """(test, defect key, occurrences) of the result summaries."""
    keys = (texts.where(F.col("defects").contains(C.DEFECT_KEY_PREFIX))
            .select("test_id", "n_rows", F.explode(F.regexp_extract_all("defects", F.lit(C.DEFECT_KEY_PATTERN), 1)).alias("defect_key")))
    return keys.groupBy("test_id", "defect_key").agg(F.sum("n_rows").alias("_occ"))


def run_defects_jira(texts: DataFrame, dedup_tests: DataFrame, raw_issues: DataFrame, as_of) -> DataFrame:
    """Per run: distinct linked issue keys overall, by status group and by
    severity, plus the mean issue age over all linked rows.

    Occurrences are first reduced to one row per (run, key); only these meet
    the issue snapshots. Each ``COUNT(DISTINCT IF(cond, key))`` becomes: per
    (run, key) whether any snapshot met ``cond``, then per run the number of
    keys that did. The occurrences weight the age average, so it stays the
    average over all linked rows."""
    per_run = (result_tests(text_keys(texts), dedup_tests)
               .groupBy("run_id", "defect_key").agg(F.sum("_occ").alias("_occ")))
    j = raw_issues.select(F.col("key").alias("j_key"), "status", "priority", "created")
    linked = per_run.join(j, F.col("defect_key") == F.col("j_key"))
    st, pr = F.col("status"), F.col("priority")
    conds = {
        "jira_defects_closed": st.isin(*C.CLOSED_DEFECT_STATUSES),
        "jira_defects_active": ~st.isin(*C.CLOSED_DEFECT_STATUSES),
        "status_ready": st.isin(*C.READY_DEFECT_STATUSES),
        "status_in_progress": st.isin(*C.IN_PROGRESS_DEFECT_STATUSES),
        "status_open": st.isin(*C.OPEN_DEFECT_STATUSES),
        "severity_critical": pr == C.SEVERITY_CRITICAL,
        "severity_high": pr == C.SEVERITY_HIGH,
        "severity_medium": pr == C.SEVERITY_MEDIUM,
        "severity_low": pr == C.SEVERITY_LOW,
    }
    age = elapsed_days(F.col("created"), ts_lit(as_of))
    per_key = linked.groupBy("run_id", "j_key").agg(
        *[F.max(F.when(c, 1).otherwise(0)).alias(n) for n, c in conds.items()],
        F.sum(age * F.col("_occ")).alias("age_sum"),
        F.sum(F.when(age.isNotNull(), F.col("_occ"))).alias("age_n"))
    return per_key.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("jira_defects_count"),
        *[F.sum(n).cast("long").alias(n) for n in conds],
        safe_divide(F.sum("age_sum"), F.sum("age_n")).alias("avg_defect_age_days"),
    )


# ------------------------------------------------------------ run_stats
def tests_per_run(run_counts: DataFrame) -> DataFrame:
    """Tests of a run, overall and by status, from its counts."""
    st, n = F.col("status_id"), F.col("n_rows")

    def rows_where(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, n)), F.lit(0).cast("long"))

    return run_counts.groupBy("run_id").agg(
        F.sum("n_tests").alias("n_tests"),
        *[rows_where(st == v).alias(f"t_{c}") for c, v in STATUS_COLUMNS.items()],
        rows_where(st.isin(C.STATUS_RETEST, C.STATUS_FAILED)).alias("t_returned"),
    )


def priority_rows_per_run(rdp: DataFrame) -> DataFrame:
    """The (run, priority) rows summed per run, with their count."""
    agg = [F.count(F.lit(1)).alias("n_prio"), F.sum("results_with_defects").alias("p_rwd"),
           F.sum("acta_count").alias("p_acta"), F.sum("iterations_count").alias("p_iters")]
    for name, prio in (("critical", C.PRIORITY_CRITICAL), ("high", C.PRIORITY_HIGH),
                       ("medium", C.PRIORITY_MEDIUM), ("low", C.PRIORITY_LOW)):
        agg.append(F.sum(F.when(F.col("priority_id") == prio, F.col("results_with_defects")).otherwise(0)).alias(f"p_{name}"))
    return rdp.groupBy("run_id").agg(*agg)


RUN_KEYS = ("plan_id", "run_id", "month_key", "project_id")


def run_stats(stg: DataFrame, run_counts: DataFrame, rdp: DataFrame, rdj: DataFrame | None,
              uat_project: int = C.MART_UAT_PROJECT, exact: bool = False, priority_breakdown: bool = False,
              keep: tuple[str, ...] = RUN_KEYS) -> DataFrame:
    """Per run: six status counts, total tests, defect / certificate /
    iteration sums, linked-issue sums and the four UAT flags.

    The reference joins runs to their tests *and* to their per-priority
    defect rows on run id only, so each run's rows number
    tests × priorities: status counts are multiplied by the priority count,
    defect sums by the test count, and issue sums by both. That result is
    reproduced exactly (``exact=False``) from per-run pre-aggregates; with
    ``exact=True`` the multiplicities are dropped. ``keep`` lists the
    columns of ``stg`` carried through (the marts keep all of them, which
    saves joining the staged runs to their own statistics)."""
    t = tests_per_run(run_counts).withColumnRenamed("run_id", "t_run_id")
    p = priority_rows_per_run(rdp).withColumnRenamed("run_id", "p_run_id")
    base = stg.select(*keep)
    j = (base.join(t, F.col("run_id") == F.col("t_run_id"), "left")
             .join(p, F.col("run_id") == F.col("p_run_id"), "left"))
    if rdj is not None:
        j = j.join(rdj.withColumnRenamed("run_id", "j_run_id"), F.col("run_id") == F.col("j_run_id"), "left")
    n_tests, n_prio = _i(F.col("n_tests")), _i(F.col("n_prio"))
    if exact:
        f_tests = f_prio = F.lit(1).cast("long")
    else:
        f_tests = F.greatest(n_tests, F.lit(1).cast("long"))
        f_prio = F.greatest(n_prio, F.lit(1).cast("long"))
    cols = [F.col(c) for c in keep]
    for n in STATUS_COLUMNS:
        cols.append((_i(F.col(f"t_{n}")) * f_prio).alias(n))
    total = n_tests * f_prio
    cols.append(total.alias("total_tests"))
    defects = _i(F.col("p_rwd")) * f_tests
    acta = _i(F.col("p_acta")) * f_tests
    cols += [defects.alias("defects_count"), acta.alias("total_acta_count"),
             (_i(F.col("p_iters")) * f_tests).alias("iterations_count")]
    if priority_breakdown:
        for name in ("critical", "high", "medium", "low"):
            cols.append((_i(F.col(f"p_{name}")) * f_tests).alias(f"defects_{name}"))
    if rdj is not None:
        for n in JIRA_COUNTS[:3]:
            cols.append((_i(F.col(n)) * f_tests * f_prio).alias(n))
        cols.append(F.col("avg_defect_age_days").alias("avg_jira_defect_age"))
        for n in JIRA_COUNTS[3:]:
            cols.append((_i(F.col(n)) * f_tests * f_prio).alias(n))
    uat = F.col("project_id") == uat_project
    passed = _i(F.col("t_passed_count")) * f_prio
    returned_tests = _i(F.col("t_returned")) * f_prio
    all_passed = (total > 0) & (passed == total)
    returned = uat & ((defects > 0) | (returned_tests > 0))
    cols += [
        F.when(returned, 1).otherwise(0).alias("is_uat_returned"),
        F.when(uat & all_passed & (acta == 0), 1).otherwise(0).alias("is_uat_certified"),
        F.when(uat & all_passed & (acta >= 1), 1).otherwise(0).alias("is_uat_signed"),
        F.when(uat & (defects == 0) & (returned_tests == 0) & (total > 0) & (passed < total), 1).otherwise(0).alias("is_uat_in_process"),
    ]
    return j.select(*cols)


# ------------------------------------------------------------ plan aggregates
def _plan_sums() -> tuple[tuple[str, Column], ...]:
    return (
        ("total_passed", F.col("passed_count")),
        ("total_returned_cases", F.col("retest_count") + F.col("failed_count")),
        ("total_in_process", F.col("process_count")),
        ("total_blocked", F.col("blocked_count")),
        ("total_untested", F.col("untested_count")),
        ("total_tests", F.col("total_tests")),
        ("total_acta_count", F.col("total_acta_count")),
        ("total_defects", F.col("defects_count")),
        ("total_iterations", F.col("iterations_count")),
    )
JIRA_SUMS = (
    ("total_jira_defects", "jira_defects_count"), ("total_jira_closed", "jira_defects_closed"),
    ("total_jira_open", "jira_defects_active"),
)
JIRA_STATUS_SUMS = (
    ("total_status_ready", "status_ready"), ("total_status_in_progress", "status_in_progress"),
    ("total_status_open", "status_open"), ("total_severity_critical", "severity_critical"),
    ("total_severity_high", "severity_high"), ("total_severity_medium", "severity_medium"),
    ("total_severity_low", "severity_low"),
)
UAT_SUMS = (("total_uat_returned", "is_uat_returned"), ("total_uat_certified", "is_uat_certified"),
            ("total_uat_signed", "is_uat_signed"), ("total_uat_in_process", "is_uat_in_process"))


def _plan_group_aggs(issues: bool, proxy_source: str, priority: bool) -> list[Column]:
    aggs = [F.sum(c).alias(n) for n, c in _plan_sums()]
    if priority:
        aggs += [F.sum(f"defects_{n}").alias(f"total_defects_{n}") for n in ("critical", "high", "medium", "low")]
    if issues:
        aggs += [F.sum(c).alias(n) for n, c in JIRA_SUMS]
        aggs.append(F.avg("avg_jira_defect_age").alias("avg_jira_defect_age"))
        aggs += [F.sum(c).alias(n) for n, c in JIRA_STATUS_SUMS]
    aggs += [F.sum(c).alias(n) for n, c in UAT_SUMS]
    aggs += [
        F.sum(F.when(F.col("is_completed_run") == F.lit(False), F.col(proxy_source)).otherwise(0)).alias("active_defects_proxy"),
        F.sum("on_time_to_qa").alias("on_time_to_qa_count"),
        F.sum("on_time_from_qa").alias("on_time_from_qa_count"),
        F.count("run_id").alias("total_runs"),
        F.avg("desviacion_inicio").alias("avg_desviacion_inicio"),
        F.max(F.coalesce(F.col("plan_is_completed"), F.col("is_completed_run"))).alias("plan_is_completed"),
        F.max("eff_plan_start_on").alias("plan_start_date"),
        F.max("eff_plan_due_on").alias("plan_due_date"),
        listagg_distinct(F.col("u_name"), C.LIST_SEPARATOR).alias("analysts"),
    ]
    return aggs


def _with_user_rows(runs: DataFrame, raw_users: DataFrame) -> DataFrame:
    """Left join to the (not deduplicated) user snapshots: a run repeats once
    per snapshot of its assignee, as in the reference. The user table is a
    small dimension; Spark broadcasts it when its estimated size is under
    the broadcast threshold and shuffles otherwise."""
    u = raw_users.select(F.col("id").alias("u_id"), F.col("name").alias("u_name"))
    return runs.join(u, F.col("assignedto_id") == F.col("u_id"), "left")


def mart_scope() -> Column:
    """Rows the mart keeps: the two special projects, or open projects that
    are not excluded (a NULL project drops out)."""
    pid = F.col("project_id")
    return ((pid == C.MART_UAT_PROJECT) | (pid == C.MART_AUTOMATION_PROJECT)
            | (~pid.isin(*C.MART_EXCLUDED_PROJECTS) & (F.col("project_is_completed") == F.lit(False))))


def plan_aggs(run_level: DataFrame, dedup_projects: DataFrame, raw_users: DataFrame) -> DataFrame:
    """Mart plan aggregates: one row per (plan-or-run, name, month, project,
    project name, certificate). ``run_level`` is ``run_stats`` computed over
    the wide staged runs, keeping all their columns (one row per run)."""
    proj = dedup_projects.select(F.col("id").alias("proj_id"), F.col("name").alias("project_name"),
                                 F.col("is_completed").alias("project_is_completed"))
    runs = run_level.join(proj, F.col("project_id") == F.col("proj_id")).where(mart_scope())
    runs = _with_user_rows(runs, raw_users)
    keys = [F.coalesce("plan_id", "run_id").alias("plan_id"), F.coalesce("plan_name", "run_name").alias("plan_name"),
            "month_key", "project_id", "project_name", "acta_certificacion"]
    return runs.groupBy(*keys).agg(*_plan_group_aggs(issues=True, proxy_source="failed_count", priority=False))


def dashboard_mart(pa: DataFrame) -> DataFrame:
    """The project-gated 42-column dashboard mart."""
    pid = F.col("project_id")
    uat = pid == C.MART_UAT_PROJECT
    auto = pid == C.MART_AUTOMATION_PROJECT
    general = ~pid.isin(C.MART_UAT_PROJECT, C.MART_AUTOMATION_PROJECT)
    done = F.col("plan_is_completed")

    def on(cond: Column, c: str, other=0) -> Column:
        return F.when(cond, F.col(c)).otherwise(F.lit(other))

    def zero_or(cond: Column, c: str) -> Column:
        return F.when(cond, F.col(c)).otherwise(F.lit(0))

    return pa.select(
        "month_key", "plan_id", F.col("plan_name").alias("Iniciativa"), "project_id", "project_name",
        F.when(uat, F.lit(None).cast("string")).when(done, F.lit(C.CERTIFIED_LABEL)).otherwise(F.lit(C.IN_PROCESS_LABEL)).alias("Estado_Iniciativa"),
        F.when(~uat & done, 1).otherwise(0).alias("is_certified"),
        F.when(~uat & ~done, 1).otherwise(0).alias("is_in_process"),
        zero_or(uat, "total_uat_returned").alias("Soluciones_Devueltas_UAT"),
        zero_or(uat, "total_uat_certified").alias("Soluciones_Certificadas_UAT"),
        zero_or(uat, "total_uat_signed").alias("Iniciativas_Firmadas_UAT"),
        zero_or(uat, "total_uat_in_process").alias("Soluciones_En_Proceso_UAT"),
        zero_or(uat, "total_iterations").alias("Iteraciones_UAT"),
        zero_or(uat, "total_passed").alias("Soluciones_Aceptadas_General"),
        zero_or(general, "on_time_to_qa_count").alias("on_time_to_qa_count"),
        zero_or(general, "on_time_from_qa_count").alias("on_time_from_qa_count"),
        zero_or(general, "total_runs").alias("total_runs"),
        safe_divide(zero_or(general, "on_time_to_qa_count"), zero_or(general, "total_runs")).alias("on_time_to_qa_rate"),
        safe_divide(zero_or(general, "on_time_from_qa_count"), zero_or(general, "total_runs")).alias("on_time_from_qa_rate"),
        F.when(general, F.col("avg_desviacion_inicio")).alias("avg_desviacion_inicio"),
        zero_or(general, "total_jira_defects").alias("Total_Defectos"),
        zero_or(general, "total_jira_open").alias("Defectos_Activos"),
        zero_or(general, "total_jira_closed").alias("Defectos_Cerrados"),
        zero_or(general, "total_severity_critical").alias("total_defects_critical"),
        zero_or(general, "total_severity_high").alias("total_defects_high"),
        zero_or(general, "total_severity_medium").alias("total_defects_medium"),
        zero_or(general, "total_severity_low").alias("total_defects_low"),
        zero_or(general, "total_status_ready").alias("total_status_ready"),
        zero_or(general, "total_status_in_progress").alias("total_status_in_progress"),
        zero_or(general, "total_status_open").alias("total_status_open"),
        F.when(general, F.col("avg_jira_defect_age")).alias("Promedio_Dias_Defecto"),
        zero_or(general, "total_returned_cases").alias("total_returned_cases"),
        zero_or(general, "total_in_process").alias("total_in_process"),
        zero_or(general, "total_blocked").alias("total_blocked"),
        zero_or(general, "total_untested").alias("total_untested"),
        zero_or(auto, "total_passed").alias("automation_passed"),
        zero_or(auto, "total_tests").alias("automation_total"),
        "total_tests",
        "total_passed",
        zero_or(general, "total_jira_defects").alias("total_defects_raw"),
        "active_defects_proxy",
        "analysts",
    )


# ------------------------------------------------------------ validation mart
VALIDATION_PROJECTS = (C.VALIDATION_GENERAL_PROJECT, C.VALIDATION_UAT_PROJECT)


def pruebas_plan_aggs(run_level: DataFrame, raw_users: DataFrame) -> DataFrame:
    """Validation plan aggregates; ``run_level`` is the validation
    ``run_stats`` over the wide staged runs of projects 17 and 12."""
    runs = _with_user_rows(run_level, raw_users)
    keys = [F.coalesce("plan_id", "run_id").alias("plan_id"), F.coalesce("plan_name", "run_name").alias("plan_name"),
            "month_key", "project_id", "acta_certificacion"]
    return runs.groupBy(*keys).agg(*_plan_group_aggs(issues=False, proxy_source="defects_count", priority=True))


def dashboard_pruebas(pa: DataFrame) -> DataFrame:
    pid = F.col("project_id")
    general = pid == C.VALIDATION_GENERAL_PROJECT
    uat = pid == C.VALIDATION_UAT_PROJECT
    done = F.col("plan_is_completed")

    def zero_or(cond: Column, c: str) -> Column:
        return F.when(cond, F.col(c)).otherwise(F.lit(0))

    return pa.select(
        "month_key", "plan_id", F.col("plan_name").alias("Iniciativa"), "project_id",
        F.when(~general, F.lit(None).cast("string")).when(done, F.lit(C.CERTIFIED_LABEL)).otherwise(F.lit(C.IN_PROCESS_LABEL)).alias("Estado_Iniciativa"),
        F.when(general & done, 1).otherwise(0).alias("is_certified"),
        F.when(general & ~done, 1).otherwise(0).alias("is_in_process"),
        zero_or(uat, "total_uat_returned").alias("Soluciones_Devueltas_UAT"),
        zero_or(uat, "total_uat_certified").alias("Soluciones_Certificadas_UAT"),
        zero_or(uat, "total_uat_signed").alias("Iniciativas_Firmadas_UAT"),
        zero_or(uat, "total_uat_in_process").alias("Soluciones_En_Proceso_UAT"),
        zero_or(uat, "total_iterations").alias("Iteraciones_UAT"),
        zero_or(uat, "total_passed").alias("Soluciones_Aceptadas_General"),
        zero_or(general, "on_time_to_qa_count").alias("on_time_to_qa_count"),
        zero_or(general, "on_time_from_qa_count").alias("on_time_from_qa_count"),
        zero_or(general, "total_runs").alias("total_runs"),
        safe_divide(zero_or(general, "on_time_to_qa_count"), zero_or(general, "total_runs")).alias("on_time_to_qa_rate"),
        safe_divide(zero_or(general, "on_time_from_qa_count"), zero_or(general, "total_runs")).alias("on_time_from_qa_rate"),
        F.when(general, F.col("avg_desviacion_inicio")).alias("avg_desviacion_inicio"),
        zero_or(general, "total_defects").alias("Total_Defectos"),
        zero_or(general, "active_defects_proxy").alias("Defectos_Activos"),
        zero_or(general, "total_defects_critical").alias("total_defects_critical"),
        zero_or(general, "total_defects_high").alias("total_defects_high"),
        zero_or(general, "total_defects_medium").alias("total_defects_medium"),
        zero_or(general, "total_defects_low").alias("total_defects_low"),
        zero_or(general, "total_returned_cases").alias("total_returned_cases"),
        zero_or(general, "total_in_process").alias("total_in_process"),
        zero_or(general, "total_blocked").alias("total_blocked"),
        zero_or(general, "total_untested").alias("total_untested"),
        "total_tests", "total_passed", "total_defects", "active_defects_proxy", "analysts",
    )


# ------------------------------------------------------------ project summary
def active_plans(dedup_plans: DataFrame) -> DataFrame:
    return (dedup_plans.where(F.col("is_completed") == F.lit(False))
            .groupBy("project_id").agg(F.count("id").alias("active_plans_count")))


def repo_cases(dedup_cases: DataFrame, dedup_suites: DataFrame) -> DataFrame:
    c = dedup_cases.where(F.col("is_deleted") == 0).select(F.col("id").alias("c_id"), "suite_id")
    s = dedup_suites.select(F.col("id").alias("s_id"), "project_id")
    return c.join(s, F.col("suite_id") == F.col("s_id")).groupBy("project_id").agg(F.count("c_id").alias("total_cases_repo"))


def exec_stats(mart: DataFrame) -> DataFrame:
    return mart.groupBy("project_id").agg(
        F.sum("total_tests").alias("total_tests_execution"),
        F.sum("total_passed").alias("total_passed"),
        F.sum("total_returned_cases").alias("total_returned"),
        F.sum("total_blocked").alias("total_blocked"),
        F.sum("total_in_process").alias("total_in_process"),
        F.sum("total_untested").alias("total_untested"),
        F.sum("Total_Defectos").alias("total_defects"),
        F.sum("Defectos_Activos").alias("active_defects"),
    )


def project_analysts(dedup_runs: DataFrame, dedup_users: DataFrame) -> DataFrame:
    """Sorted distinct analyst names on open runs per project."""
    u = dedup_users.select(F.col("id").alias("u_id"), F.col("name").alias("u_name"))
    r = dedup_runs.where(F.col("is_completed") == F.lit(False)).select("project_id", "assignedto_id")
    j = r.join(u, F.col("assignedto_id") == F.col("u_id"), "left").where(F.col("u_name").isNotNull())
    return j.groupBy("project_id").agg(listagg_distinct(F.col("u_name"), C.LIST_SEPARATOR).alias("analysts"))


def project_summary(dedup_projects: DataFrame, ap: DataFrame, rc: DataFrame, es: DataFrame, pa: DataFrame) -> DataFrame:
    """Active, non-excluded projects with plans, repository cases, execution
    totals and analysts, zero-filled. All inputs are one row per project."""
    p = dedup_projects.where((F.col("is_completed") == F.lit(False)) & ~F.col("id").isin(*C.SUMMARY_EXCLUDED_PROJECTS))
    p = p.select(F.col("id").alias("project_id"), F.col("name").alias("project_name"))
    j = (p.join(ap, "project_id", "left").join(rc, "project_id", "left")
          .join(es, "project_id", "left").join(pa, "project_id", "left"))
    z = _i
    return j.select(
        "project_id", "project_name",
        z(F.col("active_plans_count")).alias("active_plans"),
        z(F.col("total_cases_repo")).alias("total_cases_repo"),
        z(F.col("total_tests_execution")).alias("total_tests_execution"),
        z(F.col("total_passed")).alias("status_passed"),
        z(F.col("total_returned")).alias("status_returned"),
        z(F.col("total_blocked")).alias("status_blocked"),
        z(F.col("total_in_process")).alias("status_in_process"),
        z(F.col("total_untested")).alias("status_pending"),
        z(F.col("active_defects")).alias("active_defects"),
        F.coalesce(F.col("analysts"), F.lit(C.UNASSIGNED_LABEL)).alias("analysts"),
    )


# ------------------------------------------------------------ workload / demand
def _active_assignments(run_counts: DataFrame, dedup_runs: DataFrame, dedup_projects: DataFrame) -> DataFrame:
    """Assigned tests of open, non-excluded projects, counted per (run,
    assignee, status) before the run join: test ids are unique after dedup,
    so ``n_tests`` is the distinct test count, and a run holding a large share
    of the tests reaches the join as a handful of rows."""
    t = run_counts.where(F.col("assignedto_id").isNotNull() & (F.col("assignedto_id") > 0)).drop("n_rows")
    r = dedup_runs.where(~F.col("project_id").isin(*C.SUMMARY_EXCLUDED_PROJECTS)).select(
        F.col("id").alias("r_id"), "project_id", "created_on")
    proj = dedup_projects.where(F.col("is_completed") == F.lit(False)).select(
        F.col("id").alias("proj_id"), F.col("name").alias("project_name"))
    return (t.join(r, F.col("run_id") == F.col("r_id"))
             .join(proj, F.col("project_id") == F.col("proj_id")))


def _analyst_name(raw_users_name: Column, assignee: Column) -> Column:
    return F.coalesce(raw_users_name, F.concat(F.lit(C.ANALYST_FALLBACK_PREFIX), assignee.cast("string")))


def user_name_rows(raw_users: DataFrame) -> DataFrame:
    """(id, name, number of snapshot rows with that name)."""
    return raw_users.groupBy("id", "name").agg(F.count(F.lit(1)).alias("n_rows"))


def workload_by_analyst(run_counts: DataFrame, dedup_runs: DataFrame, dedup_projects: DataFrame,
                        raw_users: DataFrame) -> DataFrame:
    """Per (analyst, project): distinct tests and six status counts.

    The tests are first reduced to one row per (assignee, project); only
    then is the user table joined, and its snapshot multiplicity applied to
    the counts, so the large side never fans out."""
    a = _active_assignments(run_counts, dedup_runs, dedup_projects)
    st, n = F.col("status_id"), F.col("n_tests")

    def tests_where(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, n)), F.lit(0).cast("long"))

    # test ids are unique after dedup and the run / project joins are on
    # unique keys, so summed test counts are the distinct counts
    per = a.groupBy("assignedto_id", "project_id", "project_name").agg(
        F.sum(n).alias("total_assigned"),
        tests_where(~st.isin(C.STATUS_PASSED, C.STATUS_FAILED)).alias("active_cases"),
        tests_where(st == C.STATUS_PASSED).alias("passed_cases"),
        tests_where(st == C.STATUS_FAILED).alias("failed_cases"),
        tests_where(st == C.STATUS_BLOCKED).alias("blocked_cases"),
        tests_where(st == C.STATUS_UNTESTED).alias("untested_cases"),
        tests_where(st == C.STATUS_RETEST).alias("retest_cases"),
    )
    u = user_name_rows(raw_users).select(F.col("id").alias("u_id"), F.col("name").alias("u_name"), "n_rows")
    j = per.join(u, F.col("assignedto_id") == F.col("u_id"), "left")
    m = F.coalesce(F.col("n_rows"), F.lit(1).cast("long"))
    return j.select(
        "assignedto_id",
        _analyst_name(F.col("u_name"), F.col("assignedto_id")).alias("analyst_name"),
        "project_id", "project_name", "total_assigned",
        *[(F.col(c) * m).alias(c) for c in ("active_cases", "passed_cases", "failed_cases", "blocked_cases",
                                            "untested_cases", "retest_cases")],
    )


def project_analyst_demand(run_counts: DataFrame, dedup_runs: DataFrame, dedup_projects: DataFrame,
                           raw_users: DataFrame) -> DataFrame:
    """Per (project, month): distinct analysts, distinct tests and the sorted
    analyst names (user name, else ``Analista #id``)."""
    a = _active_assignments(run_counts, dedup_runs, dedup_projects).select(
        "project_id", "project_name", F.date_format("created_on", "yyyy-MM").alias("month_key"),
        F.year("created_on").cast("long").alias("year"), "assignedto_id", "n_tests")
    keys = ["project_id", "project_name", "month_key", "year"]
    per = a.groupBy(*keys, "assignedto_id").agg(F.sum("n_tests").alias("n_tests"))
    fallback = F.concat(F.lit(C.ANALYST_FALLBACK_PREFIX), F.col("id").cast("string"))
    names = raw_users.groupBy("id").agg(F.collect_set(F.coalesce(F.col("name"), fallback)).alias("u_names"))
    j = per.join(names, F.col("assignedto_id") == F.col("id"), "left")
    fallback = F.array(F.concat(F.lit(C.ANALYST_FALLBACK_PREFIX), F.col("assignedto_id").cast("string")))
    j = j.select(*keys, "n_tests", F.posexplode(F.coalesce(F.col("u_names"), fallback)).alias("nth", "name"))
    out = j.groupBy(*keys).agg(
        F.count_if(F.col("nth") == 0).alias("analyst_count"),
        F.sum(F.when(F.col("nth") == 0, F.col("n_tests"))).alias("test_count"),
        F.array_join(F.array_sort(F.collect_set("name")), C.LIST_SEPARATOR).alias("analyst_names"),
    )
    return out.select("project_id", "project_name", "month_key", "year", "analyst_count", "test_count", "analyst_names")


# ------------------------------------------------------------ tracker audit
def linked_info(texts: DataFrame, dedup_tests: DataFrame, stg: DataFrame, raw_projects: DataFrame) -> DataFrame:
    """Distinct (issue key, plan, project, plan name, project name) reachable
    from result texts. Keys are made distinct per test and per run before the
    joins that follow, names once per project before the last one."""
    t = dedup_tests.select(F.col("id").alias("t_id"), F.col("run_id").alias("t_run_id"))
    per_run = (text_keys(texts).join(t, F.col("test_id") == F.col("t_id"))
               .select(F.col("defect_key").alias("extracted_key"), "t_run_id").distinct())
    sr = stg.select("run_id", "plan_id", "project_id", F.coalesce("plan_name", "run_name").alias("plan_name"))
    li = (per_run.join(sr, F.col("t_run_id") == F.col("run_id"))
          .select("extracted_key", "plan_id", "project_id", "plan_name").distinct())
    p = raw_projects.select(F.col("id").alias("p_id"), F.col("name").alias("project_name")).distinct()
    return (li.join(p, F.col("project_id") == F.col("p_id"))
              .select("extracted_key", "plan_id", "project_id", "plan_name", "project_name"))


ISSUE_COLUMNS = ("id", "key", "summary", "status", "priority", "resolution", "assignee", "reporter", "created",
                 "updated", "url")


def jira_defects_summary(raw_issues: DataFrame, li: DataFrame, as_of) -> DataFrame:
    """Every issue snapshot with its age and whether / where it is linked."""
    per_key = li.groupBy("extracted_key").agg(
        listagg_distinct(F.col("plan_name"), C.LIST_SEPARATOR).alias("linked_plans"),
        listagg_distinct(F.col("project_name"), C.LIST_SEPARATOR).alias("linked_projects"),
    )
    issues = raw_issues.select(*ISSUE_COLUMNS).distinct()
    j = issues.join(per_key, F.col("key") == F.col("extracted_key"), "left")
    return j.select(
        *ISSUE_COLUMNS,
        elapsed_days(F.col("created"), ts_lit(as_of)).alias("age_days"),
        F.col("extracted_key").isNotNull().alias("is_linked"),
        "linked_plans", "linked_projects",
    )
