"""Serving (§2.D) and the final-step dataflows the dashboard ran in the
browser (§2.E), as DataFrame operators over the full marts.

The browser computed its totals on at most 1000 arbitrary rows; here every
roll-up runs on the whole relation (only ``relation_head`` and the explicit
top-k reports limit, because the limit is their feature)."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qalytics import config as C
from qalytics.functions import day_diff, safe_divide, ts_lit


def _total_order(df: DataFrame, first: list[tuple[str, Column]]) -> list[Column]:
    """The ``first`` (name, sort) pairs followed by every other column
    ascending with NULLs first, so a limit after the sort is deterministic."""
    named = {n for n, _ in first}
    return [c for _, c in first] + [F.col(f"`{c}`").asc_nulls_first() for c in df.columns if c not in named]


# ------------------------------------------------------------ §2.D
RELATION_TYPES = {
    "mart": "dashboard_mart",
    "pruebas": "dashboard_pruebas",
    "workload": "workload_by_analyst",
    "demand": "project_analyst_demand",
    "unlinked": "jira_defects_summary",
}


def relation_head(relations: Mapping[str, DataFrame] | object, kind: str | None,
                  limit: int = C.RELATION_HEAD_ROWS) -> DataFrame:
    """First ``limit`` rows of a named mart; an unknown name reads the
    dashboard mart. The reference has no ORDER BY; we pin a total order."""
    name = RELATION_TYPES.get(kind or "mart", RELATION_TYPES["mart"])
    df = relations[name] if isinstance(relations, Mapping) else getattr(relations, name)
    return df.orderBy(*_total_order(df, [])).limit(limit)


def project_summary_top(summary: DataFrame, limit: int = C.RELATION_HEAD_ROWS) -> DataFrame:
    return summary.orderBy(*_total_order(summary, [("total_cases_repo", F.col("total_cases_repo").desc()),
                                                      ("project_id", F.col("project_id").asc())])).limit(limit)


def velocity_daily(raw_results: DataFrame, as_of: _dt.datetime, days: int = C.VELOCITY_WINDOW_DAYS) -> DataFrame:
    """Results per day over the last ``days`` days before ``as_of``."""
    start = ts_lit(as_of - _dt.timedelta(days=days))
    r = raw_results.where(F.col("created_on") >= start)
    return (r.groupBy(F.date_format("created_on", "yyyy-MM-dd").alias("date"))
             .agg(F.count(F.lit(1)).alias("count")).orderBy("date"))


def automation_coverage(raw_cases: DataFrame) -> DataFrame:
    """Non-deleted cases split into automated (type 1) and manual (all else)."""
    kind = F.when(F.col("custom_automation_type") == 1, F.lit(C.AUTOMATED_LABEL)).otherwise(F.lit(C.MANUAL_LABEL))
    return raw_cases.where(F.col("is_deleted") == 0).groupBy(kind.alias("type")).agg(F.count(F.lit(1)).alias("count"))


def defect_aging_top(raw_issues: DataFrame, as_of: _dt.datetime, k: int = C.AGING_TOP_K) -> DataFrame:
    """The ``k`` oldest issues not in a done status (NULL status drops out)."""
    open_ = raw_issues.where(~F.col("status").isin(*C.AGING_CLOSED_STATUSES))
    out = open_.select(
        "key", "summary", "priority", "created",
        F.date_format("created", "yyyy-MM-dd").alias("created_date"),
        day_diff(F.lit(as_of.date()), F.to_date("created")).cast("long").alias("days_open"),
    )
    # ascending puts NULL first, as the reference warehouse does
    top = out.orderBy(F.col("created").asc_nulls_first(), F.col("key").asc_nulls_first(),
                      F.col("summary").asc_nulls_first(), F.col("priority").asc_nulls_first()).limit(k)
    return top.drop("created")


def fact_scorecards(fact: DataFrame, cycle_name: str | None = None, start_from: _dt.date | None = None,
                    start_to: _dt.date | None = None) -> DataFrame:
    """Report totals over the cycle fact with optional cycle-name and
    start-date filters."""
    f = fact
    if cycle_name is not None:
        f = f.where(F.col("cycle_name") == cycle_name)
    if start_from is not None:
        f = f.where(F.col("eff_start_date") >= F.lit(start_from))
    if start_to is not None:
        f = f.where(F.col("eff_start_date") <= F.lit(start_to))
    return f.agg(
        F.sum("passed_count").alias("passed"),
        F.sum("failed_count").alias("failed"),
        F.sum("total_tests").alias("total"),
        F.count_if(F.col("uat_certified")).alias("certified_cycles"),
        safe_divide(F.count_if(F.col("uat_certified")), F.count("cycle_id")).alias("certified_pct"),
    )


def monthly_scorecards(kpi_monthly: DataFrame) -> DataFrame:
    """Total cycles by month, each row carrying the overall on-time-start
    percentage (cycle-weighted), attached as a scalar subquery."""
    overall = kpi_monthly.agg(safe_divide(F.sum("on_time_start_count"), F.sum("total_cycles")))
    return kpi_monthly.select("month_key", "total_cycles", overall.scalar().alias("on_time_start_pct_overall"))


# ------------------------------------------------------------ §2.E
def filter_options(mart: DataFrame) -> DataFrame:
    """Month options (sorted distinct non-null) and project options (one
    name per project id, ordered by numeric id; id 0 and empty names are left
    out, as the browser does) as one relation."""
    months = (mart.where(F.col("month_key").isNotNull()).select("month_key").distinct()
              .select(F.lit("month").alias("option_type"), F.lit(None).cast("long").alias("option_id"),
                      F.col("month_key").alias("option_label")))
    projects = (mart.where((F.col("project_id") != 0) & (F.col("project_name") != ""))
                .groupBy("project_id").agg(F.max("project_name").alias("option_label"))
                .select(F.lit("project").alias("option_type"), F.col("project_id").alias("option_id"), "option_label"))
    return months.unionByName(projects).orderBy("option_type", "option_id", "option_label")


def mart_filter(mart: DataFrame, month: str | None = "All", project: str | int | None = "All") -> DataFrame:
    """Optional month / project filters; ``'All'`` (or None) means no filter."""
    out = mart
    if month not in (None, "All"):
        out = out.where(F.col("month_key") == month)
    if project not in (None, "All"):
        text = str(project)
        if text.lstrip("-").isdigit():
            # numeric comparison (same rows as comparing the text forms) so the
            # predicate can be pushed down to the scans
            out = out.where(F.col("project_id") == int(text))
        else:
            out = out.where(F.col("project_id").cast("string") == text)
    return out


def kpi_header(filtered: DataFrame, issues: DataFrame) -> DataFrame:
    """Header KPIs over the filtered mart; issue totals ignore the filters
    and are attached as scalar subqueries. An empty filtered input yields no
    row."""
    closed = F.col("status").isin(*C.CLOSED_DEFECT_STATUSES)
    totals = issues.agg(F.struct(F.count(F.lit(1)).alias("n"),
                                 F.count_if(~F.coalesce(closed, F.lit(False))).alias("active"))).scalar()
    return filtered.agg(
        F.count(F.lit(1)).alias("_n"),
        F.coalesce(F.sum("total_runs"), F.lit(0)).alias("total_runs"),
        F.coalesce(F.sum("total_passed"), F.lit(0)).alias("total_passed"),
        F.coalesce(F.sum("Soluciones_Certificadas_UAT"), F.lit(0)).alias("uat_certified"),
        F.coalesce(F.sum("Soluciones_Devueltas_UAT"), F.lit(0)).alias("uat_returned"),
        F.coalesce(F.sum("Soluciones_En_Proceso_UAT"), F.lit(0)).alias("uat_in_process"),
        F.count_if(F.col("is_certified") == 1).alias("certified_plans"),
        F.count_if(F.col("is_in_process") == 1).alias("process_plans"),
    ).where(F.col("_n") > 0).drop("_n").select(
        "*", totals.getField("n").alias("total_defects"), totals.getField("active").alias("active_defects"))


def status_breakdown(filtered: DataFrame) -> DataFrame:
    """Six status totals and their share of all tests (1 decimal). Failed is
    the residual, floored at 0; shares are 0.0 when there are no tests."""
    s = filtered.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (
        "total_tests", "total_passed", "total_returned_cases", "total_blocked", "total_untested", "total_in_process")])
    failed = F.greatest(F.lit(0), F.col("total_tests") - F.col("total_passed") - F.col("total_returned_cases")
                        - F.col("total_blocked") - F.col("total_untested") - F.col("total_in_process"))
    values = [F.col("total_passed"), failed, F.col("total_returned_cases"), F.col("total_blocked"),
              F.col("total_in_process"), F.col("total_untested")]
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(lbl).alias("label"), v.cast("long").alias("value"))
                               for i, (lbl, v) in enumerate(zip(C.BREAKDOWN_LABELS, values))])).alias("r")
    out = s.select("total_tests", rows).select("r.ord", "r.label", "r.value", "total_tests")
    pct = F.when(F.col("total_tests") > 0, F.round(F.col("value") / F.col("total_tests") * 100, 1)).otherwise(F.lit(0.0))
    return out.select("ord", "label", "value", pct.alias("pct"))


# the mart columns behind each pie slice (C.PIE_LABELS order); the failed
# slice reads a column the mart does not carry
PIE_SOURCES = ("total_passed", None, "total_blocked", "total_returned_cases", "total_untested")


def status_pie(filtered: DataFrame) -> DataFrame:
    """Five slice sums, zero slices dropped. 'Fallidos' reads a column the
    mart does not carry, so it is always 0 and dropped (as in the reference)."""
    slices_ = list(zip(C.PIE_LABELS, PIE_SOURCES))
    sums = filtered.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for _, c in slices_ if c])
    slices = F.explode(F.array(*[
        F.struct(F.lit(lbl).alias("name"), (F.col(c) if c else F.lit(0).cast("long")).alias("value"))
        for lbl, c in slices_])).alias("s")
    return sums.select(slices).select("s.name", "s.value").where(F.col("value") > 0)


def _dimension(spark, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def defects_by_severity(issues: DataFrame) -> DataFrame:
    """Issue counts for the four severities, zero-filled; others ignored."""
    dim = _dimension(issues.sparkSession, [(i, p, lbl) for i, (p, lbl) in enumerate(C.SEVERITY_LABELS)],
                     "ord int, priority string, name string")
    counts = issues.groupBy("priority").agg(F.count(F.lit(1)).alias("n"))
    return (dim.join(counts, "priority", "left")
            .select("ord", "name", F.coalesce(F.col("n"), F.lit(0)).alias("value")))


def defects_by_status(issues: DataFrame) -> DataFrame:
    """Issues grouped into four status groups; unknown or NULL status counts
    as open. Zero-filled."""
    mapping = _dimension(issues.sparkSession, list(C.STATUS_GROUPS), "status string, status_group string")
    # a few counts per status meet the mapping, not the issues
    per_status = issues.groupBy("status").agg(F.count(F.lit(1)).alias("issues"))
    grouped = (per_status.join(mapping, "status", "left")
               .select(F.coalesce(F.col("status_group"), F.lit(C.STATUS_GROUP_OPEN)).alias("name"), "issues")
               .groupBy("name").agg(F.sum("issues").alias("n")))
    dim = _dimension(issues.sparkSession, [(i, g) for i, g in enumerate(C.STATUS_GROUP_ORDER)], "ord int, name string")
    return dim.join(grouped, "name", "left").select("ord", "name", F.coalesce(F.col("n"), F.lit(0)).alias("value"))


def automation_pct(coverage: DataFrame) -> DataFrame:
    """Automated share of non-deleted cases as a rounded percentage."""
    return coverage.agg(
        F.round(F.lit(100.0) * safe_divide(F.sum(F.when(F.col("type") == C.AUTOMATED_LABEL, F.col("count")).otherwise(0)),
                                           F.sum("count")), 0).cast("long").alias("automation_pct"))


def workload_pivot(workload: DataFrame, projects: list[str]) -> DataFrame:
    """One row per analyst, one column per name in ``projects`` (assigned
    tests, NULL without any) plus the row total over all projects: one
    aggregation."""
    cells = [F.sum(F.when(F.col("project_name") == p, F.col("total_assigned"))).alias(p) for p in projects]
    return (workload.groupBy("analyst_name").agg(*cells, F.sum("total_assigned").alias("total"))
            .orderBy(F.col("total").desc(), F.col("analyst_name")))


def workload_detail(workload: DataFrame) -> DataFrame:
    return workload.orderBy(*_total_order(workload, [("total_assigned", F.col("total_assigned").desc())]))


def demand_years(demand: DataFrame, year: int | None = None) -> DataFrame:
    d = demand if year is None else demand.where(F.col("year") == year)
    return d.select("year").distinct().orderBy("year")


def demand_pivot(demand: DataFrame, projects: list[str]) -> DataFrame:
    """One row per month; per name in ``projects``: analyst count (column
    named after the project), tests (``<project>_tests``) and names
    (``<project>_names``), in one aggregation."""
    cells = [F.max(F.when(F.col("project_name") == p, F.col(c))).alias(p + suffix) for p in projects
             for c, suffix in (("analyst_count", ""), ("test_count", "_tests"), ("analyst_names", "_names"))]
    return demand.groupBy(F.col("month_key").alias("month")).agg(*cells).orderBy("month")


def demand_detail(demand: DataFrame) -> DataFrame:
    """Sorted by month and analyst count, then by every other column. The name
    lists grow with the analysts, so the ranges, whose sampled keys go to the
    driver, are drawn by the other columns: rows equal in those share a range
    and are told apart there."""
    first = [("month_key", F.col("month_key").asc()), ("analyst_count", F.col("analyst_count").desc())]
    return (demand.repartitionByRange(*_total_order(demand.drop("analyst_names"), first))
            .sortWithinPartitions(*_total_order(demand, first)))


def demand_scatter(demand: DataFrame) -> DataFrame:
    return demand.select(F.col("month_key").alias("month"), F.col("project_name").alias("project"),
                         F.col("analyst_count").alias("analysts"), F.col("test_count").alias("tests"),
                         F.col("analyst_names").alias("names"))


def unlinked_audit(summary: DataFrame, k: int = C.UNLINKED_PREVIEW_ROWS) -> DataFrame:
    """The first ``k`` issue rows (by key) with the count of unlinked issues
    (a scalar subquery over the whole relation)."""
    unlinked = summary.agg(F.count_if(~F.col("is_linked"))).scalar()
    head = (summary.select("key", "summary", "status", "priority", "url", "is_linked")
            .orderBy(F.col("key").asc_nulls_first(), F.col("status").asc_nulls_first(),
                     F.col("summary").asc_nulls_first(), F.col("priority").asc_nulls_first())
            .limit(k))
    return head.select("*", unlinked.alias("unlinked_count"))


def execution_detail(mart: DataFrame) -> DataFrame:
    return mart.orderBy(*_total_order(mart, [("month_key", F.col("month_key").desc_nulls_last())]))
