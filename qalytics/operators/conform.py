"""Conformance (bronze → silver): newest row per key, staged runs with parsed
custom fields, the cycle fact, and defect keys extracted from free text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qalytics import config as C
from qalytics.functions import elapsed_days, json_object, json_value_in, month_key, parse_day, ts_lit

EPOCH = "1970-01-01 00:00:00"


def dedup_latest(df: DataFrame, key: str = "id", order: Sequence[str] = ("_extracted_at",), pinned: bool = False) -> DataFrame:
    """Newest row per ``key`` by ``order`` (each descending, NULLs last).

    ``row_number() == 1`` over a window: Spark plans it as a partial
    WindowGroupLimit before the shuffle (each map task keeps one row per
    key, so a key holding a large share of the rows is reduced before it
    moves) and a final one after it. Unlike a struct-max aggregate, the
    window lets Catalyst prune every column the consumer does not read down
    to the parquet scan. Rows tied on all ``order`` columns are resolved
    arbitrarily, as in the reference; pass a tie-break column in ``order``
    where one exists, or ``pinned`` to break ties by a hash of the whole row
    (which reads every column): then the result does not depend on the order
    or the batches in which rows arrive."""
    ties = [F.xxhash64(*sorted(df.columns)).desc()] if pinned else []
    order = [c for c in order if c in df.columns]
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc_nulls_last() for c in order], *ties)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


# ---------------------------------------------------------------- stg_runs
def prepared_plans(dedup_plans: DataFrame) -> DataFrame:
    """Parse each plan's custom fields once (the SQL form re-parses them up
    to six times per run row) and derive the effective dates."""
    v = json_object("custom_fields")
    p = dedup_plans.select("id", "name", "created_on", "completed_on", "is_completed", v.alias("_cf"))
    s1, s2 = (json_value_in(F.col("_cf"), k) for k in C.START_DATE_KEYS)
    d1, d2 = (json_value_in(F.col("_cf"), k) for k in C.DUE_DATE_KEYS)
    a1, a2 = (json_value_in(F.col("_cf"), k) for k in C.PLAN_CERTIFICATE_KEYS)
    p = p.select(
        F.col("id").alias("p_id"),
        F.col("name").alias("plan_name"),
        F.col("created_on").alias("p_created_on"),
        F.col("completed_on").alias("p_completed_on"),
        F.col("is_completed").alias("p_is_completed"),
        F.coalesce(a1, a2).alias("acta_certificacion"),
        F.coalesce(parse_day(s1), parse_day(s2)).alias("parsed_start"),
        F.coalesce(parse_day(d1), parse_day(d2)).alias("parsed_due"),
        (s1.isNotNull() | s2.isNotNull()).alias("plan_has_start_key"),
    )
    return p


def prepared_milestones(dedup_milestones: DataFrame) -> DataFrame:
    v = json_object("custom_fields")
    m = dedup_milestones.select("id", "name", v.alias("_cf"))
    s1, s2 = (json_value_in(F.col("_cf"), k) for k in C.START_DATE_KEYS)
    return m.select(F.col("id").alias("m_id"), F.col("name").alias("milestone_name"),
                    (s1.isNotNull() | s2.isNotNull()).alias("milestone_has_start_key"))


def run_last_date(created: Column, completed: Column) -> Column:
    return F.coalesce(completed, created, ts_lit(EPOCH))


def plan_max_dates(dedup_runs: DataFrame) -> DataFrame:
    """Latest run date per plan, projects 12/21/7 left out."""
    r = dedup_runs.where(~F.col("project_id").isin(*C.LAST_CYCLE_EXCLUDED_PROJECTS))
    return r.groupBy("plan_id").agg(F.max(run_last_date(F.col("created_on"), F.col("completed_on"))).alias("max_date"))


STG_COLUMNS = ("project_id", "plan_id", "plan_name", "run_id", "run_name", "milestone_id", "milestone_name",
               "created_on_run", "completed_on_run", "is_completed_run", "assignedto_id", "acta_certificacion",
               "eff_plan_start_on", "eff_plan_due_on", "on_time_to_qa", "on_time_from_qa", "is_blocked",
               "is_last_cycle", "desviacion_inicio", "month_key")


def stg_runs(dedup_runs: DataFrame, dedup_plans: DataFrame, dedup_milestones: DataFrame) -> DataFrame:
    """One row per run with plan / milestone context and the on-time,
    blocked, last-cycle and deviation measures (20 columns)."""
    return stg_runs_wide(dedup_runs, dedup_plans, dedup_milestones).select(*STG_COLUMNS)


def stg_runs_wide(dedup_runs: DataFrame, dedup_plans: DataFrame, dedup_milestones: DataFrame,
                  only: Column | None = None) -> DataFrame:
    """``stg_runs`` plus the plan's own completion flag (``plan_is_completed``),
    which the marts read; carrying it saves a second join to the plans.
    ``only`` restricts the staged runs; a plan's latest date still looks at all."""
    pmd = plan_max_dates(dedup_runs).withColumnRenamed("plan_id", "pmd_plan_id")
    r = dedup_runs.where(only) if only is not None else dedup_runs
    r = r.select("id", "project_id", "plan_id", "name", "milestone_id", "created_on", "completed_on",
                 "is_completed", "assignedto_id")
    # Plans with their latest run date, one row per plan id. The join key is
    # derived (coalesce over the full join), so unless the plans are small
    # enough to broadcast, both sides reach the join through a shuffle and AQE
    # can split a plan holding most runs, or the NULL plan of standalone runs.
    # (Joined on the plan id itself, the plans would arrive pre-partitioned
    # by the newest-row window, only the runs would be shuffled, and AQE
    # could not split them.)
    plans = prepared_plans(dedup_plans).join(pmd, F.col("p_id") == F.col("pmd_plan_id"), "full")
    plans = plans.withColumn("_plan_key", F.coalesce("p_id", "pmd_plan_id"))
    j = (r.join(plans, F.col("plan_id") == F.col("_plan_key"), "left")
          .join(prepared_milestones(dedup_milestones), F.col("milestone_id") == F.col("m_id"), "left"))
    created, completed = F.col("created_on"), F.col("completed_on")
    start, due = F.col("parsed_start"), F.col("parsed_due")
    on_time_to_qa = F.when(created.isNotNull() & start.isNotNull(), F.when(created <= start, 1).otherwise(0)).otherwise(0)
    on_time_from_qa = F.when(F.col("is_completed") & completed.isNotNull() & due.isNotNull(),
                             F.when(completed <= due, 1).otherwise(0)).otherwise(0)
    is_blocked = F.when(
        (F.col("m_id").isNotNull() & F.col("milestone_has_start_key"))
        & (F.col("p_id").isNotNull() & ~F.col("plan_has_start_key")), 1).otherwise(0)
    is_last_cycle = F.when(
        F.col("plan_id").isNotNull() & F.col("max_date").isNotNull()
        & (run_last_date(created, completed) == F.col("max_date")), 1).otherwise(0)
    deviation = elapsed_days(F.coalesce(start, created), F.coalesce(created, ts_lit(EPOCH)))
    return j.select(
        "project_id",
        "plan_id",
        "plan_name",
        F.col("id").alias("run_id"),
        F.col("name").alias("run_name"),
        "milestone_id",
        "milestone_name",
        created.alias("created_on_run"),
        completed.alias("completed_on_run"),
        F.col("is_completed").alias("is_completed_run"),
        "assignedto_id",
        "acta_certificacion",
        F.coalesce(start, F.col("p_created_on")).alias("eff_plan_start_on"),
        F.coalesce(due, F.col("p_completed_on")).alias("eff_plan_due_on"),
        on_time_to_qa.alias("on_time_to_qa"),
        on_time_from_qa.alias("on_time_from_qa"),
        is_blocked.alias("is_blocked"),
        is_last_cycle.alias("is_last_cycle"),
        deviation.alias("desviacion_inicio"),
        month_key(F.coalesce(created, completed)).alias("month_key"),
        F.col("p_is_completed").alias("plan_is_completed"),
    )


# ---------------------------------------------------------------- fact_cycle
FACT_COLUMNS = ("cycle_id", "project_id", "plan_id", "plan_name", "cycle_name", "created_on", "completed_on",
                "is_closed", "passed_count", "failed_count", "blocked_count", "total_tests", "month_key",
                "eff_start_date", "eff_due_date", "on_time_start", "on_time_end", "is_blocked", "uat_certified")


def fact_cycle(raw_runs: DataFrame, raw_plans: DataFrame) -> DataFrame:
    """Cycle fact over the raw (not deduplicated) runs and plans; measures
    are gated to the general project (17) and UAT project (23)."""
    runs = raw_runs.select("id", "project_id", "plan_id", "name", "created_on", "completed_on", "is_completed",
                           "passed_count", "failed_count", "blocked_count", "retest_count", "untested_count")
    plans = raw_plans.select(F.col("id").alias("p_id"), F.col("name").alias("plan_name"))
    j = runs.join(plans, F.col("plan_id") == F.col("p_id"), "left")
    general = F.col("project_id") == C.FACT_GENERAL_PROJECT
    uat = F.col("project_id") == C.FACT_UAT_PROJECT
    total = (F.col("passed_count") + F.col("failed_count") + F.col("blocked_count")
             + F.col("retest_count") + F.col("untested_count"))
    start_date = F.to_date("created_on")
    due_date = F.date_add(start_date, C.PLANNED_CYCLE_DAYS)

    def gated(c: Column) -> Column:
        return F.when(general, c).otherwise(F.lit(0))

    return j.select(
        F.col("id").alias("cycle_id"),
        "project_id",
        "plan_id",
        "plan_name",
        F.col("name").alias("cycle_name"),
        "created_on",
        "completed_on",
        F.col("is_completed").alias("is_closed"),
        gated(F.col("passed_count")).alias("passed_count"),
        gated(F.col("failed_count")).alias("failed_count"),
        gated(F.col("blocked_count")).alias("blocked_count"),
        gated(total).alias("total_tests"),
        month_key("created_on").alias("month_key"),
        start_date.alias("eff_start_date"),
        due_date.alias("eff_due_date"),
        F.when(general, F.lit(True)).alias("on_time_start"),
        F.when(general & F.col("is_completed") & (F.to_date("completed_on") <= due_date), True).otherwise(False).alias("on_time_end"),
        F.when(general & (F.col("blocked_count") > 0), True).otherwise(False).alias("is_blocked"),
        F.when(uat & (total > 0) & ((F.col("passed_count") / total) >= C.UAT_PASS_THRESHOLD), True).otherwise(False).alias("uat_certified"),
    )


# ---------------------------------------------------------------- defect keys
def defect_keys(raw_results: DataFrame, text_col: str = "defects", keep: Sequence[str] = ("id", "test_id")) -> DataFrame:
    """One row per defect key found anywhere in a result's free text
    (every match, whole text). Rows without the key prefix are dropped
    before the regex runs."""
    r = raw_results.where(F.col(text_col).contains(C.DEFECT_KEY_PREFIX))
    keys = F.regexp_extract_all(F.col(text_col), F.lit(C.DEFECT_KEY_PATTERN), 1)
    return r.select(*keep, F.explode(keys).alias("defect_key"))


# ---------------------------------------------------------------- summaries
def run_test_counts(dedup_tests: DataFrame) -> DataFrame:
    """Tests per (run, assignee, status): every mart that counts tests reads
    this instead of the tests. The counts are partial aggregates before the
    shuffle, so a run holding most tests moves as a few rows per map task."""
    return dedup_tests.groupBy("run_id", "assignedto_id", "status_id").agg(
        F.count("id").alias("n_tests"), F.count(F.lit(1)).alias("n_rows"))


def result_texts(raw_results: DataFrame) -> DataFrame:
    """Results per (test, defect text): rows, rows with a defect, certificates
    and iterations. Results are only ever added, so the summaries of several
    loads are simply read together: every consumer sums them."""
    cf = json_object("custom_fields")
    return (raw_results.select("test_id", "defects", cf.alias("_cf"))
            .groupBy("test_id", "defects").agg(
                F.count(F.lit(1)).alias("n_rows"),
                F.count_if(F.col("defects").isNotNull() & (F.col("defects") != "")).alias("rwd"),
                F.count_if(json_value_in(F.col("_cf"), C.RESULT_CERTIFICATE_KEY).isNotNull()).alias("acta"),
                F.count_if(json_value_in(F.col("_cf"), C.ITERATION_KEY) == "true").alias("iters")))
