"""Incremental refresh: a new load changes only the partitions it touches.

``refresh_pending`` brings the written layers up to the newest commit, epoch
by epoch. Per epoch:

1. From the load and the layers as they are, semi-joins find what the load
   touches: the key ranges of its rows; the runs whose own record, plan,
   milestone, tests, results, cases or linked issues it holds (a plan's runs
   are touched together: its latest date tells which is the last cycle); the
   months of the cycle fact; the projects of touched runs. They are written
   down first, so a run that died can be repeated.
2. Newest-row tables: old rows of the touched ranges and the new rows are
   merged by newest stamp, ties by the whole row, so the outcome does not
   depend on how rows were dealt to loads.
3. Result summaries: those of the load are added beside the older ones.
4. Per-run tables, the cycle fact and the dashboard mart are computed for the
   touched ranges, months and projects only, and replace these partitions.
   Dimensions of a few thousand rows, gold tables and the smaller marts are
   written whole: they read per-run silver, never tests or results.

Every step writes aside before it overwrites and can be repeated. Names of
partitions reach the driver; rows never do.
"""

from __future__ import annotations

import datetime as _dt
import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qalytics import config as C
from qalytics.operators import conform, ingest, marts
from qalytics.plans import layout as L
from qalytics.plans import medallion as M
from qalytics.session import path_exists, remove_path

RANGED = {"raw_tests": "dedup_tests", "raw_runs": "dedup_runs", "raw_plans": "dedup_plans", "raw_cases": "dedup_cases"}
WHOLE = {"raw_projects": "dedup_projects", "raw_users": "dedup_users", "raw_milestones": "dedup_milestones", "raw_suites": "dedup_suites"}
NEWEST = {"raw_tests": ("_extracted_at", "_tiebreak")}
_TOUCHED = "kind string, run_id long, value string"


def merge_newest(old: DataFrame, new: DataFrame, order: tuple[str, ...] = ("_extracted_at",)) -> DataFrame:
    """The newest row per id of a newest-row table and rows to be merged into
    it. Equals the batch form over all rows, in whatever batches they come."""
    return conform.dedup_latest(old.unionByName(new.select(*old.columns)), order=order, pinned=True)


class _Load:
    """The layers before a load, and the load's own rows."""

    def __init__(self, spark: SparkSession, sf_dir: str, root: str, as_of: _dt.datetime, epoch: int):
        tokens = L.loads(spark, root, last=epoch)
        self.rel = M.MaterializedRelations(spark, sf_dir, root, as_of, tokens=tokens)
        self.token = tokens[-1]
        self.tables = [t for t in M.BRONZE_TABLES if path_exists(spark, os.path.join(root, "bronze", t, f"load={self.token}"))]

    def rows(self, table: str) -> DataFrame:
        """The load's rows of a table; none if it brings none."""
        return self.rel.bronze.landed(table, [self.token] if table in self.tables else []).drop(*L.ADDED_COLUMNS)

    def ids(self, table: str, column: str = "id", name: str = "_id") -> DataFrame:
        return self.rows(table).select(F.col(column).alias(name)).where(F.col(name).isNotNull()).distinct()


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, frames)


def touched_by(load: _Load) -> DataFrame:
    """(kind, run_id, value) of what a load touches: staged runs (``stg``), runs
    with changed tests, results or issues (``run``), months (``month``) and
    projects (``project``)."""
    rel, rows, ids = load.rel, load.rows, load.ids

    def semi(df: DataFrame, on: str, frame: DataFrame) -> DataFrame:
        return df.join(frame, F.col(on) == F.col("_id"), "left_semi")

    runs, tests = rel.dedup_runs, rel.dedup_tests
    own = rows("raw_runs")
    plans = _union([ids("raw_plans"), ids("raw_runs", "plan_id"),
                    semi(runs, "id", ids("raw_runs")).select(F.col("plan_id").alias("_id"))]).distinct()
    staged = _union([own.select("id"), semi(runs, "plan_id", plans).select("id"),
                     semi(runs, "milestone_id", ids("raw_milestones")).select("id")]).distinct()
    keys = marts.text_keys(rel.result_texts).select("test_id", "defect_key")
    linked = semi(keys, "defect_key", ids("raw_jira_issues", "key")).select(F.col("test_id").alias("_id"))
    of_tests = _union([ids("raw_tests"), ids("raw_results", "test_id"), linked]).distinct()
    counted = _union([rows("raw_tests").select("run_id"),
                      semi(rows("raw_tests"), "id", ids("raw_results", "test_id")).select("run_id"),
                      semi(tests, "id", of_tests).select("run_id"),
                      semi(tests, "case_id", ids("raw_cases")).select("run_id")]).distinct()
    both = _union([staged.select(F.col("id").alias("_id")), counted.select(F.col("run_id").alias("_id"))])
    months = _union([own, semi(rel.bronze.raw_runs, "plan_id", ids("raw_plans"))]).select(
        F.date_format("created_on", "yyyy-MM").alias("value")).distinct()
    projects = _union([semi(rel.stg_runs_wide, "run_id", both).select("project_id"), own.select("project_id"),
                       rows("raw_projects").select(F.col("id").alias("project_id"))]).distinct()

    def kind(name: str, run: str = "CAST(NULL AS LONG)", value: str = "CAST(NULL AS STRING)"):
        return [f"'{name}' AS kind", f"{run} AS run_id", f"{value} AS value"]

    return _union([staged.selectExpr(*kind("stg", "id")), counted.selectExpr(*kind("run", "run_id")),
                   months.selectExpr(*kind("month", value="value")),
                   projects.selectExpr(*kind("project", value="CAST(project_id AS STRING)"))])


def _values(df: DataFrame, expression: str) -> list:
    """Distinct partition values (their number is that of the partitions)."""
    return [r[0] for r in df.select(F.expr(expression).alias("v")).distinct().collect()]


def apply_epoch(spark: SparkSession, sf_dir: str, root: str, epoch: int, as_of: _dt.datetime,
                before: _dt.datetime, spans: dict[str, int]) -> dict[str, list]:
    """Bring the layers from the epoch before to ``epoch``. Returns the
    partitions rewritten, per table (an empty list for a table written whole)."""
    by = L.splits(spans)
    work = os.path.join(root, "work", f"epoch={epoch}")
    load = _Load(spark, sf_dir, root, as_of, epoch)
    noted = os.path.join(work, "touched")
    if not path_exists(spark, os.path.join(noted, "_SUCCESS")):
        L.write(touched_by(load), noted)
    touched = spark.read.schema(_TOUCHED).parquet(noted)
    done: dict[str, list] = {}

    def rewrite(table: str, make, parts: list, layer: str = "silver") -> None:
        if parts:
            L.overwrite_parts(spark, make, os.path.join(root, layer, table), by[table], parts, os.path.join(work, table))
            done[table] = parts

    def now() -> M.MaterializedRelations:
        return M.MaterializedRelations(spark, sf_dir, root, as_of, tokens=load.rel.bronze.tokens)

    for raw, table in RANGED.items():
        if raw in load.tables:
            value = by[table].value
            parts = _values(load.rows(raw), value)
            old = getattr(load.rel, table).where(L.in_parts(value, parts))
            rewrite(table, lambda: merge_newest(old, load.rows(raw), NEWEST.get(raw, ("_extracted_at",))), parts)
    for raw, table in WHOLE.items():
        if raw in load.tables:
            L.write(conform.dedup_latest(getattr(load.rel.bronze, raw), pinned=True), os.path.join(root, "silver", table))
            done[table] = []
    if "raw_results" in load.tables:
        L.write(conform.result_texts(load.rows("raw_results")), os.path.join(root, "silver", "result_texts", f"load={load.token}"))
        done["result_texts"] = [load.token]

    rel = now()
    run_range = by["run_test_counts"].value
    staged = _values(touched.where("kind = 'stg'"), run_range)
    counted = _values(touched.where("kind = 'run'"), run_range)
    on_id = run_range.replace("run_id", "id")
    rewrite("stg_runs_wide", lambda: conform.stg_runs_wide(rel.dedup_runs, rel.dedup_plans, rel.dedup_milestones,
                                                           only=L.in_parts(on_id, staged)), staged)
    tests = rel.dedup_tests.where(L.in_parts(run_range, counted))
    rewrite("run_test_counts", lambda: conform.run_test_counts(tests), counted)
    rewrite("run_defects_priority", lambda: marts.run_defects_priority(rel.result_texts, tests, rel.raw_cases), counted)
    # issue ages follow the clock: on another day every run's mean age changes
    aged = counted if as_of == before else _values(rel.dedup_tests, run_range)
    rewrite("run_defects_jira", lambda: marts.run_defects_jira(
        rel.result_texts, rel.dedup_tests.where(L.in_parts(run_range, aged)), rel.raw_jira_issues, as_of), aged)

    months = _values(touched.where("kind = 'month'"), "value")
    raw_runs = rel.bronze.landed("raw_runs").where(L.in_parts("created_month", months)).drop(*L.ADDED_COLUMNS)
    rewrite("fact_cycle", lambda: conform.fact_cycle(raw_runs, rel.raw_plans), months)

    M.build_layer(now(), root, "gold", M.GOLD_TABLES, spans=spans)
    everything = "raw_users" in load.tables or as_of != before
    projects = _values(rel.stg_runs_wide if everything else touched.where("kind = 'project'"),
                       "project_id" if everything else "CAST(value AS LONG)")
    rewrite("dashboard_mart", lambda: _mart_of(now(), projects), projects, "mart")
    M.build_layer(now(), root, "mart", tuple(t for t in M.MART_TABLES if t != "dashboard_mart"), spans=spans)
    M.mark_refreshed(spark, root, epoch, as_of, spans)
    remove_path(spark, work)
    return done


def _mart_of(rel: M.MaterializedRelations, projects: list) -> DataFrame:
    wide = rel.stg_runs_wide.where(L.in_parts("project_id", projects))
    stats = marts.run_stats(wide, rel.run_test_counts, rel.run_defects_priority, rel.run_defects_jira, keep=tuple(wide.columns))
    return marts.dashboard_mart(marts.plan_aggs(stats, rel.dedup_projects, rel.raw_users))


def refresh_pending(spark: SparkSession, sf_dir: str, root: str, as_of: _dt.datetime = C.DEFAULT_AS_OF) -> dict[int, dict[str, list]]:
    """Apply every committed epoch that the layers do not contain yet."""
    last = L.epochs(spark, root, "refreshed")[-1]
    out = {}
    for epoch in (e for e in L.epochs(spark, root) if e > last):
        was = spark.read.parquet(os.path.join(root, "refreshed", f"epoch={L.epochs(spark, root, 'refreshed')[-1]}")).first()
        out[epoch] = apply_epoch(spark, sf_dir, root, epoch, as_of, was["as_of"], dict(zip(was["tables"], was["spans"])))
    return out


def landed_rows(rel: M.MaterializedRelations, table: str, rows: DataFrame) -> DataFrame:
    """Rows shaped as the landed table: its columns and types, in its order."""
    have = set(rows.columns)
    kinds = getattr(rel.bronze, table).schema
    return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds])


def land_changes(spark: SparkSession, sf_dir: str, root: str, changes: dict[str, DataFrame], as_of: _dt.datetime,
                 scopes: dict[str, tuple[str, str]] | None = None) -> dict:
    """Land one load of changed rows and commit it with the watermarks it
    moves. ``scopes`` names, per table, its entity in the sync state and its
    scope column. Raises ``StateConflict`` if another load was committed
    meanwhile; the load is then invisible and the call can be repeated."""
    rel = M.MaterializedRelations(spark, sf_dir, root, as_of)
    state, epoch = L.state_at(spark, root)
    was = spark.read.parquet(os.path.join(root, "refreshed", f"epoch={L.epochs(spark, root, 'refreshed')[-1]}")).first()
    token = L.new_load()
    shaped = {t: landed_rows(rel, t, M.stamped(df, as_of)) for t, df in changes.items()}
    counts = M.land(spark, root, shaped, as_of, token, dict(zip(was["tables"], was["spans"])))
    moved = [ingest.watermark_advance(rel.bronze.landed(t, [token]), state, entity, as_of, scope)
             for t, (entity, scope) in (scopes or {}).items() if t in changes]
    L.commit(spark, root, epoch + 1, ingest.sync_state_merge(state, _union(moved)) if moved else state, token)
    return {"epoch": epoch + 1, "load": token, "counts": counts}


def sync(spark: SparkSession, sf_dir: str, root: str, pulled: dict[str, DataFrame], as_of: _dt.datetime,
         scopes: dict[str, tuple[str, str]]) -> dict:
    """One whole cycle: of the pulled records take those after their scope's
    watermark (tables without a scope are taken whole), land and commit them,
    and refresh what they touch."""
    state, _ = L.state_at(spark, root)
    changes = {t: ingest.incremental_extract(df, state, *scopes[t]) if t in scopes else df for t, df in pulled.items()}
    report = land_changes(spark, sf_dir, root, changes, as_of, scopes)
    report["rewritten"] = refresh_pending(spark, sf_dir, root, as_of)
    return report
