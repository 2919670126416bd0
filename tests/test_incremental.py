"""A refresh of a small load equals a full rebuild and rewrites only the
partitions it touches."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from qalytics.operators import conform
from qalytics.plans import incremental as I
from qalytics.plans import layout as L
from qalytics.plans import medallion as M
from qalytics.session import fresh_shared_path
from tests.conftest import SF0001, rows

LATER = dt.datetime(2024, 1, 20)
SPANS = {"dedup_tests": 6000, "dedup_runs": 600, "dedup_plans": 20, "dedup_cases": 40, "runs": 12}


def files(root, *layers):
    return {p: os.stat(p).st_mtime_ns for layer in layers for p in glob.glob(f"{root}/{layer}/**/*.parquet", recursive=True)}


def stamp(df, when=LATER):
    return df.withColumn("_extracted_at", F.lit(when).cast("timestamp_ntz"))


def changes_of(rel):
    """About one row in a hundred: runs that close, move plan or are new,
    tests that change status or run, new results, issues that move on, a new
    snapshot of a plan and of a case."""
    b = rel.bronze
    runs = rel.dedup_runs.where("id BETWEEN 700 AND 712")
    closed = stamp(runs.withColumns({"is_completed": F.lit(True), "completed_on": F.lit(LATER).cast("timestamp_ntz")}))
    moved = stamp(rel.dedup_runs.where("id = 800").withColumn("plan_id", F.lit(3).cast("long")))
    new = stamp(rel.dedup_runs.where("id = 801").withColumns({"id": F.lit(900_001).cast("long"), "name": F.lit("new")}))
    tests = rel.dedup_tests.where("run_id BETWEEN 700 AND 705")
    changed = stamp(tests.withColumn("status_id", F.lit(1).cast("long")))
    elsewhere = stamp(rel.dedup_tests.where("run_id = 1000").withColumn("run_id", F.lit(704).cast("long")))
    results = b.raw_results.where("id BETWEEN 40 AND 60").withColumns({
        "id": F.col("id") + 10_000_000, "defects": F.lit("CM-3 and CM-4"), "created_on": F.lit(LATER).cast("timestamp_ntz")})
    issues = stamp(b.raw_jira_issues.where("id IN ('3', '5')").withColumn("status", F.lit("Terminado")))
    plans = stamp(rel.dedup_plans.where("id = 7").withColumns({"name": F.lit("renamed"), "is_completed": F.lit(True)}))
    cases = stamp(rel.dedup_cases.where("id = 11").withColumn("priority_id", F.lit(4).cast("long")))
    return {"raw_runs": closed.unionByName(moved).unionByName(new), "raw_tests": changed.unionByName(elsewhere),
            "raw_results": results.drop("_extracted_at"), "raw_jira_issues": issues, "raw_plans": plans, "raw_cases": cases}


def same_layers(got, want):
    for names in (M.SILVER_TABLES, M.GOLD_TABLES, M.MART_TABLES):
        for name in names:
            if name == "result_texts":  # per load: equal once summed
                def total(r):
                    return r.result_texts.groupBy("test_id", "defects").agg(*[F.sum(c).alias(c) for c in ("n_rows", "rwd", "acta", "iters")])
                assert rows(total(got)) == rows(total(want)), name
            else:
                assert rows(getattr(got, name)) == rows(getattr(want, name)), name


@pytest.fixture(scope="module")
def built(spark):
    root = fresh_shared_path(spark, "incremental")
    rel = M.refresh(spark, SF0001, root, spans=SPANS)
    return root, rel


def test_small_load_equals_full_rebuild_and_touches_few_partitions(spark, built):
    root, rel = built
    changes = {t: df for t, df in changes_of(rel).items()}
    report = I.land_changes(spark, SF0001, root, changes, LATER, {"raw_runs": ("runs", "project_id")})
    assert report["epoch"] == 1 and report["counts"]["raw_plans"] == 1
    before = files(root, "silver")
    done = I.refresh_pending(spark, SF0001, root, rel.as_of)[1]
    after = files(root, "silver")
    got = M.MaterializedRelations(spark, SF0001, root, rel.as_of)
    other = fresh_shared_path(spark, "rebuilt")
    same_layers(got, M.build(spark, SF0001, other, rel.as_of, spans=SPANS, bronze_root=root))
    # untouched partitions keep their files; most are untouched
    for table in ("dedup_tests", "dedup_runs", "stg_runs_wide", "run_test_counts", "run_defects_priority", "run_defects_jira", "fact_cycle"):
        column = L.splits(SPANS)[table].column
        touched = {f"{column}={L.NULL_PARTITION if p is None else p}" for p in done[table]}
        old = {p for p in before if f"/{table}/" in p}
        kept = {p for p in old if not any(f"/{t}/" in p for t in touched)}
        assert kept and all(after.get(p) == before[p] for p in kept), table
        assert not any(after.get(p) == before[p] for p in old - kept), table
    assert len(done["dedup_tests"]) <= 3 and len(done["fact_cycle"]) < 40
    # nothing is pending, and the load's rows are in the audit and the state
    assert I.refresh_pending(spark, SF0001, root, rel.as_of) == {}
    assert {r["entity"]: r["rows"] for r in M.audit(spark, root).where(F.col("load") == report["load"]).collect()}["runs"] == report["counts"]["raw_runs"]
    assert got.bronze.sync_state.where("last_sync_ts = TIMESTAMP_NTZ'2024-01-20 00:00:00'").count() > 0


def test_interrupted_refresh_is_repeated(spark, built, monkeypatch):
    root, rel = built
    now = M.MaterializedRelations(spark, SF0001, root, rel.as_of)
    tests = stamp(now.dedup_tests.where("run_id = 1200").withColumn("run_id", F.lit(1300).cast("long")), dt.datetime(2024, 1, 21))
    I.land_changes(spark, SF0001, root, {"raw_tests": tests}, dt.datetime(2024, 1, 21))
    fail = L.overwrite_parts

    def dies(spark_, make, path, *rest):
        if path.endswith("run_test_counts"):
            raise RuntimeError("lost")
        fail(spark_, make, path, *rest)

    monkeypatch.setattr(L, "overwrite_parts", dies)
    with pytest.raises(RuntimeError, match="lost"):
        I.refresh_pending(spark, SF0001, root, rel.as_of)
    monkeypatch.setattr(L, "overwrite_parts", fail)
    done = I.refresh_pending(spark, SF0001, root, rel.as_of)
    # the tests have moved already, but the run they left is still rewritten
    assert set(done[2]["run_test_counts"]) == {1200 // 12, 1300 // 12}
    got = M.MaterializedRelations(spark, SF0001, root, rel.as_of)
    assert rows(got.run_test_counts) == rows(conform.run_test_counts(got.dedup_tests))
    assert got.run_test_counts.where("run_id = 1200").isEmpty()


def test_uncommitted_loads_are_invisible(spark, built):
    root, rel = built
    M.land(spark, root, {"raw_plans": rel.bronze.raw_plans.limit(5)}, LATER, L.new_load())
    assert len(L.loads(spark, root)) == len(L.epochs(spark, root))
    assert M.LandedBronze(spark, SF0001, root).raw_plans.count() == sum(
        r["rows"] for r in M.audit(spark, root).where("entity = 'plans'").collect())


def test_newest_rows_do_not_depend_on_batches(spark):
    data = [(i % 5, dt.datetime(2024, 1, 1 + (i * 7) % 3), f"v{i}") for i in range(40)] + [(None, None, "n1"), (None, None, "n2")]
    df = spark.createDataFrame(data, "id long, _extracted_at timestamp_ntz, name string")
    want = rows(conform.dedup_latest(df, pinned=True))
    assert len(want) == 6
    for cut in (3, 11, 17):
        for step in (1, -1):
            batches = [data[i:i + cut] for i in range(0, len(data), cut)][::step]
            table = spark.createDataFrame([], df.schema)
            for batch in batches:
                table = spark.createDataFrame(rows(I.merge_newest(table, spark.createDataFrame(batch, df.schema))), df.schema)
            assert rows(table) == want


def test_tables_without_rows_keep_their_columns(spark):
    root = fresh_shared_path(spark, "empty-layers")
    source = M.Relations(spark, SF0001)
    for name in M.BRONZE_TABLES:
        source.bronze.__dict__[name] = getattr(source.bronze, name).where("false")
    M.land_bronze(source, root)
    landed = M.LandedBronze(spark, SF0001, root)
    assert all(getattr(landed, t).isEmpty() for t in ("raw_runs", "raw_results", "raw_tests"))
    rel = M.MaterializedRelations(spark, SF0001, root)
    M.build_layer(rel, root, "silver", ("dedup_runs", "dedup_tests", "run_test_counts"))
    again = M.MaterializedRelations(spark, SF0001, root)
    assert again.dedup_runs.isEmpty() and "plan_id" in again.dedup_runs.columns
    assert again.run_test_counts.columns == ["run_id", "assignedto_id", "status_id", "n_tests", "n_rows"]
