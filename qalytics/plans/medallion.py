"""The medallion build (bronze → silver → gold → marts) as written tables.

Every relation in ``Relations`` is a lazy plan over the raw tables, which is
what the registered queries use. A production refresh instead writes each
layer once to the shared folder named by ``spark.checkpoint.dir`` and lets
the next layer read the written tables:

* silver relations (deduplicated entities, staged runs, the cycle fact, test
  counts and result summaries) feed several marts; writing them once replaces
  one shuffle of the largest tables per consumer with a column-pruned read;
* a written table cuts the lineage: a lost executor recomputes from the last
  written layer, not from the raw scans;
* tables are partitioned (``plans/layout.py``): results by day and runs by
  month, so that date filters prune files; silver by key ranges, so that a
  later refresh (``plans/incremental.py``) rewrites only what changed.
"""

from __future__ import annotations

import datetime as _dt
import os
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qalytics import config as C
from qalytics.functions import ts_lit
from qalytics.operators import conform, serving
from qalytics.operators.conform import FACT_COLUMNS
from qalytics.plans import layout as L
from qalytics.plans.relations import Relations
from qalytics.session import fresh_shared_path, path_exists
from qalytics.sources.fixtures import Bronze

BRONZE_TABLES = ("raw_projects", "raw_users", "raw_milestones", "raw_plans", "raw_runs", "raw_runs_dirty",
                 "raw_cases", "raw_suites", "raw_tests", "raw_results", "raw_jira_issues", "raw_statuses")
SILVER_TABLES = ("dedup_runs", "dedup_plans", "dedup_milestones", "dedup_tests", "dedup_projects", "dedup_users",
                 "dedup_cases", "dedup_suites", "stg_runs_wide", "fact_cycle", "run_test_counts", "result_texts",
                 # per-run defect statistics: both dashboard marts read them
                 "run_defects_priority", "run_defects_jira")
GOLD_TABLES = ("kpi_monthly_performance", "kpi_by_plan", "kpi_uat_certification", "kpis_plan", "kpis_mes",
               "data_quality")
MART_TABLES = ("dashboard_mart", "dashboard_pruebas", "workload_by_analyst", "project_analyst_demand",
               "jira_defects_summary", "project_summary")
COLUMN_ORDER = {"fact_cycle": FACT_COLUMNS}
# Result summaries are kept per load; a build joins those of all loads.
ALL_LOADS = "load=all"
DONE = {"result_texts": (ALL_LOADS,)}


class LandedBronze(Bronze):
    """Bronze tables read from their committed loads below ``root``."""

    def __init__(self, spark: SparkSession, sf_dir: str, root: str, as_of: _dt.datetime = C.DEFAULT_AS_OF,
                 tokens: list[str] | None = None):
        super().__init__(spark, sf_dir, as_of)
        self.root = root
        self.tokens = L.loads(spark, root) if tokens is None else tokens

    def landed(self, name: str, tokens: list[str] | None = None) -> DataFrame:
        """A table's rows of the given loads, with its partition columns."""
        def empty() -> DataFrame:
            df = stamped(object.__getattribute__(self, name), self.as_of).withColumn("load", F.lit(None).cast("string"))
            split = L.splits(L.KEY_SPANS).get(name)
            return df.withColumn(split.column, F.expr(split.value)) if split else df

        df = L.read(self.spark, os.path.join(self.root, "bronze", name), empty)
        return df.where(F.col("load").isin(self.tokens if tokens is None else tokens))

    def __getattribute__(self, name: str):
        if name in BRONZE_TABLES:
            return object.__getattribute__(self, "landed")(name).drop(*L.ADDED_COLUMNS)
        if name == "sync_state":
            state, epoch = L.state_at(self.spark, self.root)
            if epoch >= 0:
                return state
        return object.__getattribute__(self, name)


class MaterializedRelations(Relations):
    """Relations whose bronze, silver, gold and mart layers are read from a
    medallion build under ``root`` (whatever has been written)."""

    pinned = True

    def __init__(self, spark: SparkSession, sf_dir: str, root: str, as_of: _dt.datetime = C.DEFAULT_AS_OF,
                 bronze_root: str | None = None, tokens: list[str] | None = None):
        super().__init__(spark, sf_dir, as_of, bronze=LandedBronze(spark, sf_dir, bronze_root or root, as_of, tokens))
        self.root = root
        known = {"silver": SILVER_TABLES, "gold": GOLD_TABLES, "mart": MART_TABLES}
        self._written = {layer: {n for n in names if path_exists(spark, os.path.join(root, layer, n, *DONE.get(n, ()), "_SUCCESS"))}
                         for layer, names in known.items()}

    @cached_property
    def stg_runs(self) -> DataFrame:
        return self.stg_runs_wide.select(*conform.STG_COLUMNS)

    def __getattribute__(self, name: str):
        if not name.startswith("_") and name not in ("root", "spark", "sf_dir", "as_of", "bronze"):
            written = object.__getattribute__(self, "_written")
            for layer in ("silver", "gold", "mart"):
                if name in written[layer]:
                    path = os.path.join(self.root, layer, name)
                    df = L.read(self.spark, path, lambda: object.__getattribute__(self, name))
                    # a partition column is read back last: restore the declared order
                    return df.select(*COLUMN_ORDER[name]) if name in COLUMN_ORDER else df.drop(*L.ADDED_COLUMNS)
        return object.__getattribute__(self, name)

    @cached_property
    def velocity_daily(self) -> DataFrame:
        # results are day-partitioned: the date predicate prunes whole folders
        start = self.as_of - _dt.timedelta(days=C.VELOCITY_WINDOW_DAYS)
        r = self.bronze.landed("raw_results").where(F.col("created_date") >= F.lit(start.date()))
        return serving.velocity_daily(r.drop(*L.ADDED_COLUMNS), self.as_of)


# ------------------------------------------------------------ landing
def stamped(df: DataFrame, as_of: _dt.datetime) -> DataFrame:
    """Rows with a load stamp (those that come with one keep it)."""
    return df if "_extracted_at" in df.columns else df.withColumn("_extracted_at", ts_lit(as_of))


def land(spark: SparkSession, root: str, tables: dict[str, DataFrame], as_of: _dt.datetime, load: str,
         spans: dict[str, int] = L.KEY_SPANS) -> dict[str, int]:
    """Write one load of bronze tables and its audit rows (rows per entity,
    counted by the writes themselves). Nothing sees it until it is committed."""
    by = L.splits(spans)
    counts = {}
    for name, df in tables.items():
        counts[name] = L.write(stamped(df, as_of), os.path.join(root, "bronze", name, f"load={load}"), by.get(name), count=True)
    audit = [(name.removeprefix("raw_"), as_of, n) for name, n in counts.items()]
    (spark.createDataFrame(audit, "entity string, landed_at timestamp_ntz, rows long").coalesce(1)
     .write.mode("overwrite").parquet(os.path.join(root, "audit", f"load={load}")))
    return counts


def audit(spark: SparkSession, root: str) -> DataFrame:
    """Rows landed per committed load and entity."""
    df = spark.read.schema("entity string, landed_at timestamp_ntz, rows long, load string").parquet(os.path.join(root, "audit"))
    return df.where(F.col("load").isin(L.loads(spark, root)))


def land_bronze(rel: Relations, root: str, load: str | None = None, spans: dict[str, int] = L.KEY_SPANS) -> None:
    """The first load: all bronze tables and the sync state that goes with them."""
    load = load or L.new_load()
    land(rel.spark, root, {name: getattr(rel.bronze, name) for name in BRONZE_TABLES}, rel.as_of, load, spans)
    L.commit(rel.spark, root, 0, rel.bronze.sync_state, load)


# ------------------------------------------------------------ layers
def build_layer(rel: Relations, root: str, layer: str, names: tuple[str, ...], timings: dict | None = None,
                spans: dict[str, int] = L.KEY_SPANS) -> None:
    """Write ``names`` in order; each written table is read back by the
    tables after it (the project summary reads the written mart)."""
    import time

    by = L.splits(spans)
    if isinstance(rel, MaterializedRelations):
        rel._written[layer].difference_update(names)  # noqa: SLF001  (an older version is not their source)
    for name in names:
        t0 = time.perf_counter()
        path = os.path.join(root, layer, name)
        L.write(getattr(rel, name), os.path.join(path, *DONE.get(name, ())), by.get(name))
        if isinstance(rel, MaterializedRelations):
            rel._written[layer].add(name)  # noqa: SLF001
        if timings is not None:
            timings[f"{layer}.{name}"] = round(time.perf_counter() - t0, 3)


class QualityGateError(RuntimeError):
    """Raised by a strict refresh when a data-quality check has failures."""


def quality_gate(rel: Relations) -> dict[str, int]:
    """The failing checks of the written gold ``data_quality`` table (four
    rows at most reach the driver)."""
    return {r["check_name"]: r["failures"] for r in rel.data_quality.where("failures > 0").collect()}


def build(spark: SparkSession, sf_dir: str, root: str, as_of: _dt.datetime = C.DEFAULT_AS_OF, timings: dict | None = None,
          strict_quality: bool = False, spans: dict[str, int] = L.KEY_SPANS, bronze_root: str | None = None) -> MaterializedRelations:
    """Write silver, gold and marts from the committed loads."""
    import time

    def relations() -> MaterializedRelations:
        return MaterializedRelations(spark, sf_dir, root, as_of, bronze_root)

    last = L.epochs(spark, bronze_root or root)[-1]
    for step, layer, names in (("silver_build", "silver", SILVER_TABLES), ("gold_build", "gold", GOLD_TABLES),
                               ("mart_build", "mart", MART_TABLES)):
        t0 = time.perf_counter()
        build_layer(relations(), root, layer, names, spans=spans)
        if timings is not None:
            timings[step] = round(time.perf_counter() - t0, 3)
        if strict_quality and layer == "gold":
            failing = quality_gate(relations())
            if failing:
                raise QualityGateError(f"data-quality checks failed: {failing}")
    mark_refreshed(spark, root, last, as_of, spans)
    return relations()


def mark_refreshed(spark: SparkSession, root: str, epoch: int, as_of: _dt.datetime, spans: dict[str, int]) -> None:
    """Note that the layers contain ``epoch``, with the settings they have."""
    row = [(as_of, list(spans), list(spans.values()))]
    (spark.createDataFrame(row, "as_of timestamp_ntz, tables array<string>, spans array<long>").coalesce(1)
     .write.mode("overwrite").parquet(os.path.join(root, "refreshed", f"epoch={epoch}")))


def refresh(spark: SparkSession, sf_dir: str, root: str | None = None, as_of: _dt.datetime = C.DEFAULT_AS_OF,
            timings: dict | None = None, strict_quality: bool = False,
            spans: dict[str, int] = L.KEY_SPANS) -> MaterializedRelations:
    """Run the whole build; returns relations that read the written layers.
    ``timings`` (if given) receives the seconds spent per layer. With
    ``strict_quality`` the build stops after the gold layer when a
    data-quality check fails (the reference only reports them)."""
    import time

    root = root or fresh_shared_path(spark, "medallion")
    t0 = time.perf_counter()
    land_bronze(Relations(spark, sf_dir, as_of), root, spans=spans)
    if timings is not None:
        timings["bronze_land"] = round(time.perf_counter() - t0, 3)
    return build(spark, sf_dir, root, as_of, timings, strict_quality, spans)
