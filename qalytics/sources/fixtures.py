"""Bronze relations over the provided parquet tables.

The reference lands API records into append-only ``raw_*`` tables. Here the
same relations are derived from the provided TPC-H-style tables following
FIXTURES.md §2 (nation → projects, customer → plans and tracker issues,
orders → runs, lineitem → tests, part → cases and suites, events → results,
supplier → users). Each relation is a lazy DataFrame; nothing is collected.
"""

from __future__ import annotations

import datetime as _dt
import os
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qalytics import config as C
from qalytics.functions import ts_lit

LOAD_1 = "2024-01-01 00:00:00"  # older snapshot
LOAD_2 = "2024-01-02 00:00:00"  # newer snapshot

PROVIDED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


class Bronze:
    """Lazy bronze relations for one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str, as_of: _dt.datetime = C.DEFAULT_AS_OF):
        self.spark = spark
        self.sf_dir = sf_dir
        self.as_of = as_of

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.sf_dir, f"{name}.parquet"))

    # ------------------------------------------------------------ dimensions
    @cached_property
    def raw_projects(self) -> DataFrame:
        n = self.table("nation")
        key = F.col("n_nationkey")
        current = n.select(
            key.cast("long").alias("id"),
            F.col("n_name").alias("name"),
            (key % 5 == 4).alias("is_completed"),
            (1 + key % 3).cast("long").alias("suite_mode"),
            ts_lit(LOAD_2).alias("_extracted_at"),
        )
        old = n.where(key % 2 == 1).select(
            key.cast("long").alias("id"),
            F.concat(F.col("n_name"), F.lit(" (old)")).alias("name"),
            F.lit(False).alias("is_completed"),
            F.lit(1).cast("long").alias("suite_mode"),
            ts_lit(LOAD_1).alias("_extracted_at"),
        )
        return current.unionByName(old)

    @cached_property
    def raw_users(self) -> DataFrame:
        s = self.table("supplier").where(F.col("s_suppkey") % 7 != 3)
        current = s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
                           ts_lit(LOAD_2).alias("_extracted_at"))
        old = s.where(F.col("s_suppkey") % 9 == 1).select(
            F.col("s_suppkey").alias("id"), F.concat(F.col("s_name"), F.lit(" (old)")).alias("name"),
            ts_lit(LOAD_1).alias("_extracted_at"))
        return current.unionByName(old)

    @cached_property
    def raw_milestones(self) -> DataFrame:
        r = self.table("region")
        return r.select(
            F.col("r_regionkey").cast("long").alias("id"),
            F.col("r_name").alias("name"),
            F.when(F.col("r_regionkey") % 2 == 0, F.lit('{"custom_fechainicio":"1998-01-01"}')).alias("custom_fields"),
            ts_lit(LOAD_1).alias("_extracted_at"),
        )

    @cached_property
    def raw_plans(self) -> DataFrame:
        c = self.table("customer")
        k4 = F.col("c_custkey") % 4
        custom = (F.when(k4 == 0, F.lit('{"custom_fecha_de_inicio":"1998-06-01","custom_fecha_de_finalizacion":"1999-06-01","custom_acta_de_certificacin":"A1"}'))
                  .when(k4 == 1, F.lit('{"custom_fechainicio":"1997-03-01","custom_fechafinal":"1999-03-01"}'))
                  .when(k4 == 2, F.lit('{"custom_fecha_de_inicio":"1998-02-30","custom_fechafinal":"n/a"}')))
        completed = F.col("c_acctbal") < 3000
        return c.select(
            F.col("c_custkey").alias("id"),
            F.col("c_nationkey").cast("long").alias("project_id"),
            F.col("c_name").alias("name"),
            completed.alias("is_completed"),
            ts_lit("1998-01-01 00:00:00").alias("created_on"),
            F.when(completed, ts_lit("1999-01-01 00:00:00")).alias("completed_on"),
            custom.alias("custom_fields"),
            ts_lit(LOAD_1).alias("_extracted_at"),
        )

    @cached_property
    def raw_cases(self) -> DataFrame:
        p = self.table("part")
        size = F.col("p_size")
        return p.select(
            F.col("p_partkey").alias("id"),
            F.substr(F.col("p_brand"), F.lit(7)).cast("long").alias("suite_id"),
            (1 + size % 4).cast("long").alias("priority_id"),
            F.when(size > 45, 1).otherwise(0).cast("long").alias("is_deleted"),
            F.when(size % 3 == 0, 1).when(size % 3 == 1, 0).cast("long").alias("custom_automation_type"),
            ts_lit(LOAD_1).alias("_extracted_at"),
        )

    @cached_property
    def raw_suites(self) -> DataFrame:
        p = self.table("part")
        sid = F.substr(F.col("p_brand"), F.lit(7)).cast("long")
        return p.select(
            sid.alias("id"), (sid % 25).alias("project_id"), F.col("p_brand").alias("name"),
            ts_lit(LOAD_1).alias("_extracted_at"),
        ).distinct()

    @cached_property
    def raw_statuses(self) -> DataFrame:
        """The statuses that tests have, by name."""
        names = {C.STATUS_PASSED: "passed", C.STATUS_BLOCKED: "blocked", C.STATUS_UNTESTED: "untested",
                 C.STATUS_RETEST: "retest", C.STATUS_FAILED: "failed", C.STATUS_IN_PROCESS: "in process"}
        named = F.coalesce(*[F.when(F.col("status_id") == k, F.lit(v)) for k, v in names.items()])
        return self.raw_tests.select(F.col("status_id").alias("id"), named.alias("name")).distinct()

    # ------------------------------------------------------------ facts
    @cached_property
    def raw_tests(self) -> DataFrame:
        li = self.table("lineitem")
        status = F.when(F.col("l_orderkey") % 7 == 0, F.lit(1)).otherwise(
            1 + F.col("l_quantity").cast("int") % 6).cast("long")
        return li.select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
            F.col("l_partkey").alias("case_id"),
            F.col("l_orderkey").alias("run_id"),
            status.alias("status_id"),
            F.when(F.col("l_linenumber") < 7, F.col("l_suppkey")).alias("assignedto_id"),
            F.col("l_shipdate").alias("_extracted_at"),
            F.col("l_extendedprice").alias("_tiebreak"),
        )

    @cached_property
    def _runs_base(self) -> DataFrame:
        o = self.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
        cust = self.table("customer").select("c_custkey", "c_nationkey")
        st = F.col("status_id")
        counts = self.raw_tests.groupBy("run_id").agg(
            *[F.sum(F.when(st == s, 1).otherwise(0)).alias(f"p{s}") for s in range(1, 6)])
        key = F.col("o_orderkey")
        done = F.col("o_orderstatus") == "F"
        joined = (o.join(cust, o.o_custkey == cust.c_custkey)
                  .join(counts, counts.run_id == o.o_orderkey, "left"))
        return joined.select(
            key.alias("id"),
            F.col("c_nationkey").cast("long").alias("project_id"),
            F.when(key % 10 != 0, F.col("o_custkey")).alias("plan_id"),
            (key % 6).alias("milestone_id"),
            F.concat(F.lit("run-"), key.cast("string")).alias("name"),
            done.alias("is_completed"),
            F.col("o_orderdate").alias("created_on"),
            F.when(done, F.date_add(F.to_date("o_orderdate"), (key % 30).cast("int")).cast("timestamp_ntz")).alias("completed_on"),
            (key % 10).alias("assignedto_id"),
            F.coalesce(F.col("p1"), F.lit(0)).cast("long").alias("passed_count"),
            F.coalesce(F.col("p2"), F.lit(0)).cast("long").alias("blocked_count"),
            F.coalesce(F.col("p3"), F.lit(0)).cast("long").alias("untested_count"),
            F.coalesce(F.col("p4"), F.lit(0)).cast("long").alias("retest_count"),
            F.coalesce(F.col("p5"), F.lit(0)).cast("long").alias("failed_count"),
            ts_lit(LOAD_2).alias("_extracted_at"),
        )

    @cached_property
    def raw_runs(self) -> DataFrame:
        base = self._runs_base
        old = base.where(F.col("id") % 50 == 0).withColumns({
            "is_completed": F.lit(False),
            "completed_on": F.lit(None).cast("timestamp_ntz"),
            "_extracted_at": ts_lit(LOAD_1),
        })
        return base.unionByName(old)

    @cached_property
    def raw_runs_dirty(self) -> DataFrame:
        r = self.raw_runs
        return r.select(
            "id", "project_id", "is_completed",
            F.when(F.col("id") % 700 == 5, ts_lit("2030-01-01 00:00:00")).otherwise(F.col("created_on")).alias("created_on"),
            "completed_on",
            F.when(F.col("id") % 500 == 3, F.lit(-1).cast("long")).otherwise(F.col("passed_count")).alias("passed_count"),
            "failed_count", "plan_id", "name", "blocked_count", "retest_count", "untested_count",
        )

    @cached_property
    def raw_results(self) -> DataFrame:
        e = self.table("events")
        eid, uid, et = F.col("event_id"), F.col("user_id"), F.col("event_type")
        defects = (F.when(et == "error", F.concat(F.lit("CM-"), uid.cast("string"), F.lit(", CM-"), (uid + 50).cast("string")))
                   .when(et == "click", F.lit(""))
                   .when(et == "signup", F.concat(F.lit("CM-"), eid.cast("string"))))
        custom = F.when(et == "purchase", F.lit('{"custom_result_acta_certificacion":"doc","custom_reincidencia":true}')).otherwise(F.col("props"))
        return e.select(
            eid.alias("id"),
            ((eid - eid % 4) * 10 + 1 + uid % 4).alias("test_id"),
            F.col("ts").alias("created_on"),
            defects.alias("defects"),
            custom.alias("custom_fields"),
        )

    @cached_property
    def _issues_base(self) -> DataFrame:
        c = self.table("customer")
        k = F.col("c_custkey")
        k12, k5 = k % 12, k % 5
        status = F.lit(None).cast("string")
        for i, name in reversed(list(enumerate((
                "Terminado", "Cerrado", "Cancelado", "Mitigado", "Listo para Probar", "Desarrollo", "Probando",
                "Analisis", "En Diseño", "Backlog", "Esperando Aprobación")))):
            status = F.when(k12 == i, F.lit(name)).otherwise(status)
        priority = (F.when(k5 == 0, "Crítica").when(k5 == 1, "Alta").when(k5 == 2, "Media").when(k5 == 3, "Baja"))
        key = F.concat(F.lit("CM-"), k.cast("string"))
        return c.select(
            k.cast("string").alias("id"),
            key.alias("key"),
            F.col("c_name").alias("summary"),
            status.alias("status"),
            priority.alias("priority"),
            F.when(k12 < 4, F.lit("Hecho")).alias("resolution"),
            F.col("c_mktsegment").alias("assignee"),
            F.lit("qa").alias("reporter"),
            F.date_add(F.lit(_dt.date(2023, 1, 1)), (k % 365).cast("int")).cast("timestamp_ntz").alias("created"),
            ts_lit("2024-01-01 00:00:00").alias("updated"),
            F.concat(F.lit("https://tracker.example/browse/CM-"), k.cast("string")).alias("url"),
            ts_lit(LOAD_2).alias("_extracted_at"),
        )

    @cached_property
    def raw_jira_issues(self) -> DataFrame:
        base = self._issues_base
        old = base.where(F.col("id").endswith("7")).withColumns({
            "status": F.lit("Backlog"),
            "resolution": F.lit(None).cast("string"),
            "_extracted_at": ts_lit(LOAD_1),
        })
        return base.unionByName(old)

    @cached_property
    def sync_state(self) -> DataFrame:
        """Per-project watermark of the older run load, plus one row with a
        NULL scope (tracker issues)."""
        r = self.raw_runs.where(F.col("_extracted_at") == ts_lit(LOAD_1))
        runs_state = r.groupBy("project_id").agg(
            F.max(F.unix_seconds(F.col("created_on").cast("timestamp"))).alias("last_updated_at_watermark"),
            F.max("_extracted_at").alias("last_sync_ts"),
        ).select(
            F.lit("runs").alias("entity_type"),
            F.col("project_id").cast("string").alias("scope_id"),
            "last_updated_at_watermark", "last_sync_ts",
            F.lit("SUCCESS").alias("status"),
        )
        issues_state = self.raw_jira_issues.agg(
            F.max(F.unix_seconds(F.col("updated").cast("timestamp"))).alias("last_updated_at_watermark"),
            F.max("_extracted_at").alias("last_sync_ts"),
        ).select(
            F.lit("jira_issues").alias("entity_type"), F.lit(None).cast("string").alias("scope_id"),
            "last_updated_at_watermark", "last_sync_ts", F.lit("SUCCESS").alias("status"),
        )
        return runs_state.unionByName(issues_state)
