"""Landed records: what the ingest jobs receive from the source systems,
derived from the provided tables (FIXTURES.md §1 describes the shapes).

Records carry epoch-second timestamps, nested objects and fields the bronze
schemas do not declare, so the ingest operators have real work to do."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qalytics.sources.fixtures import LOAD_2, Bronze
from qalytics.functions import ts_lit

TRACKER_URL = "https://tracker.example"


def _epoch(c: str):
    return F.unix_seconds(F.col(c).cast("timestamp"))


class Landed:
    def __init__(self, bronze: Bronze):
        self.bronze = bronze

    @cached_property
    def runs(self) -> DataFrame:
        """Current run records as the API returns them."""
        r = self.bronze.raw_runs.where(F.col("_extracted_at") == ts_lit(LOAD_2))
        counts = F.struct(*[F.col(c).alias(c.replace("_count", "")) for c in
                            ("passed_count", "blocked_count", "untested_count", "retest_count", "failed_count")])
        return r.select(
            "id", "project_id", "plan_id", "milestone_id", "name", "is_completed",
            _epoch("created_on").alias("created_on"), _epoch("completed_on").alias("completed_on"),
            "assignedto_id", "passed_count", "blocked_count", "untested_count", "retest_count", "failed_count",
            counts.alias("custom_status_count"), F.lit("unused").alias("refs_unknown"),
        )

    @cached_property
    def plan_docs(self) -> DataFrame:
        """Plan documents with nested runs: a document holds a plan's runs of
        one stretch of 64 run ids, in two entries, and an entry without runs."""
        o = self.bronze.table("orders").where(F.col("o_orderkey") % 10 != 0)
        c = self.bronze.table("customer").select("c_custkey", "c_name", "c_nationkey")
        key, cust = F.col("o_orderkey"), F.col("c_custkey")
        done = F.col("o_orderstatus") == "F"
        text = key.cast("string")
        run = F.struct(
            key.alias("id"), (key % 4 + 1).alias("suite_id"), F.concat(F.lit("run-"), text).alias("name"),
            F.when(key % 3 == 0, F.concat(F.lit("about "), text)).alias("description"),
            F.concat(F.lit("browser "), (key % 4).cast("string")).alias("config"),
            _epoch("o_orderdate").alias("created_on"), (_epoch("o_orderdate") + 3600).alias("updated_on"),
            F.when(done, F.unix_seconds(F.date_add(F.to_date("o_orderdate"), (key % 30).cast("int")).cast("timestamp"))).alias("completed_on"),
            done.alias("is_completed"), (key % 6).alias("milestone_id"), (key % 10).alias("assignedto_id"), (key % 9).alias("created_by"),
            (key % 5).alias("passed_count"), (key % 3).alias("blocked_count"), (key % 2).alias("untested_count"),
            (key % 4).alias("retest_count"), (key % 6).alias("failed_count"),
            F.when(key % 2 == 1, F.struct((key % 7).alias("x"))).alias("custom_status_count"),
            F.concat(F.lit("https://qa.example/runs/"), text).alias("url"), F.lit("unknown").alias("refs"))
        per = (o.join(c, F.col("o_custkey") == cust).groupBy("c_custkey", "c_name", "c_nationkey", F.expr("o_orderkey DIV 64").alias("stretch"))
               .agg(F.collect_list(run).alias("runs")))

        def entry(some):
            return F.struct(F.filter("runs", some).alias("runs"))

        nothing = F.struct(F.filter("runs", lambda r: F.lit(False)).alias("runs"))
        doc = F.to_json(F.struct(
            cust.alias("id"), F.col("c_name").alias("name"), F.lit(883612800).cast("long").alias("created_on"),
            F.when(cust % 4 == 0, F.lit("1998-06-01")).alias("custom_fecha_de_inicio"),
            F.when(cust % 3 != 2, cust % 5).alias("custom_nivel"),
            F.array(entry(lambda r: r["id"] % 2 == 0), nothing, entry(lambda r: r["id"] % 2 == 1)).alias("entries")))
        return per.select(F.col("c_nationkey").cast("long").alias("project_id"), doc.alias("doc"))

    @cached_property
    def milestone_docs(self) -> DataFrame:
        """Milestone documents, some with ``custom_*`` keys."""
        r = self.bronze.table("region")
        key = F.col("r_regionkey").cast("long")
        doc = F.to_json(F.struct(
            key.alias("id"), F.col("r_name").alias("name"), F.lit(884000000).cast("long").alias("due_on"), (key == 3).alias("is_completed"),
            F.when(key % 2 == 0, F.lit("1998-01-01")).alias("custom_fechainicio"), F.when(key == 4, key).alias("custom_orden")))
        return r.select((key * 5).alias("project_id"), doc.alias("doc"))

    @cached_property
    def case_pages(self) -> DataFrame:
        """Responses to the case requests: pages per suite for multi-suite
        projects, per project for others; some are cut short."""
        c = self.bronze.raw_cases
        s = self.bronze.raw_suites.select(F.col("id").alias("s_id"), F.col("project_id"))
        p = self.bronze.raw_projects.where(F.col("_extracted_at") == ts_lit(LOAD_2)).select(F.col("id").alias("p_id"), "suite_mode")
        j = c.join(s, F.col("suite_id") == F.col("s_id")).join(p, F.col("project_id") == F.col("p_id"))
        case = F.struct("id", F.col("suite_id"), "priority_id", "is_deleted")
        pages = (j.groupBy("project_id", F.when(F.col("suite_mode") == 3, F.col("suite_id")).alias("suite_id"), F.expr("id DIV 250").alias("page"))
                 .agg(F.to_json(F.struct(F.collect_list(case).alias("cases"))).alias("body")))
        cut = (F.col("project_id") % 7 == 3) & (F.col("page") % 2 == 0)
        return pages.withColumn("body", F.when(cut, F.expr("left(body, length(body) - 2)")).otherwise(F.col("body")))

    @cached_property
    def result_records(self) -> DataFrame:
        """Result records as JSON text, some with ``custom_*`` keys."""
        e = self.bronze.table("events")
        et = F.col("event_type")
        rec = F.to_json(F.struct(
            F.col("event_id").alias("id"),
            ((F.col("event_id") - F.col("event_id") % 4) * 10 + 1 + F.col("user_id") % 4).alias("test_id"),
            F.when(et.isin("purchase", "signup"), F.lit("doc")).alias("custom_result_acta_certificacion"),
            F.when(et == "purchase", F.lit(True)).alias("custom_reincidencia"),
            F.when(et == "error", F.struct((F.col("user_id") % 3).alias("level"))).alias("custom_severity"),
            F.col("value").alias("elapsed_value"),
        ))
        return e.select(F.col("event_id").alias("id"), rec.alias("record"))

    @cached_property
    def issue_docs(self) -> DataFrame:
        """Tracker issues as nested documents; times carry a -05:00 offset and
        a few are not parsable."""
        i = self.bronze._issues_base  # noqa: SLF001  (same source rows)
        k = F.col("id").cast("long")
        created_txt = F.when(k % 50 == 0, F.lit("n/a")).otherwise(
            F.concat(F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("-0500")))

        def named(c: str, field: str = "name"):
            return F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias(field)))

        doc = F.to_json(F.struct(
            "id", "key",
            F.struct(
                "summary", named("status").alias("status"), named("priority").alias("priority"),
                named("assignee", "displayName").alias("assignee"), named("reporter", "displayName").alias("reporter"),
                named("resolution").alias("resolution"), created_txt.alias("created"),
                F.concat(F.date_format("updated", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+0000")).alias("updated"),
            ).alias("fields")))
        return i.select(doc.alias("doc"))
