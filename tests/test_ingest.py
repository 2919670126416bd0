import datetime as dt

from pyspark.sql import functions as F

from qalytics import schemas as S
from qalytics.operators import ingest
from tests.conftest import rows

T = dt.datetime
AS_OF = T(2024, 2, 10)


def test_bronze_append_projects_stamps_and_normalises(spark):
    df = spark.createDataFrame([(1, 5, 1704067200, "run", "junk")], "id long, project_id long, created_on long, name string, unknown string")
    out = ingest.bronze_append(df, "raw_runs", AS_OF)
    assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in S.RAW_RUNS]
    r = out.collect()[0]
    assert r["created_on"] == T(2024, 1, 1) and r["_extracted_at"] == AS_OF and r["_source"] == "testrail"
    assert r["completed_on"] is None and "unknown" not in out.columns
    empty = spark.createDataFrame([], df.schema)
    assert ingest.bronze_append(empty, "raw_runs", AS_OF).count() == 0


def test_epoch_normalize_passes_non_integers(spark):
    df = spark.createDataFrame([("1704067200",), ("2024-01-05 10:00:00",), ("garbage",)], "created_on string")
    got = [r[0] for r in ingest.epoch_normalize(df).collect()]
    assert got == [T(2024, 1, 1), T(2024, 1, 5, 10), None]


def test_collect_custom_fields(spark):
    df = spark.createDataFrame([(1, '{"id":1,"custom_a":true,"custom_b":{"x":1},"name":"n"}'), (2, '{"id":2}')],
                               "id long, record string")
    got = dict(rows(ingest.collect_custom_fields(df), "id", "custom_fields"))
    assert got == {1: '{"custom_a":true,"custom_b":{"x":1}}', 2: None}


def test_explode_plan_entries_skips_empty_entries(spark):
    doc = '{"id":9,"entries":[{"runs":[{"id":1,"name":"a","created_on":0},{"id":2,"name":"b"}]},{},{"runs":[]}]}'
    df = spark.createDataFrame([(4, doc), (4, '{"id":8}')], "project_id long, doc string")
    got = rows(ingest.explode_plan_entries(df), "id", "plan_id", "project_id", "created_on")
    assert got == [(1, 9, 4, T(1970, 1, 1)), (2, 9, 4, None)]


def test_nested_runs_keep_every_declared_column(spark):
    run = ('{"id":1,"suite_id":4,"milestone_id":"7","name":"a","description":"d","config":"c","is_completed":true,"completed_on":"2024-01-05 10:00:00",'
           '"passed_count":1,"blocked_count":2,"untested_count":3,"retest_count":4,"failed_count":5,"custom_status_count":{"b":1,"a":[2]},'
           '"created_on":60,"created_by":9,"url":"u","updated_on":null,"assignedto_id":8,"refs":"dropped","name2":1}')
    docs = [(4, '{"id":9,"entries":[{"runs":[%s,{"id":2}]},{"runs":"none"},7,{"runs":[{"id":3}]}]}' % run), (5, "not json"), (5, None),
            (5, '{"id":1,"entries":{}}')]
    got = ingest.bronze_append(ingest.explode_plan_entries(spark.createDataFrame(docs, "project_id long, doc string")), "raw_runs", AS_OF)
    assert got.columns == [f.name for f in S.RAW_RUNS]
    first, second, third = sorted(got.collect(), key=lambda r: r["id"])
    assert tuple(first) == (1, 4, 7, 9, 4, "a", "d", "c", True, T(2024, 1, 5, 10), 1, 2, 3, 4, 5, '{"a":[2],"b":1}', T(1970, 1, 1, 0, 1), 9, "u",
                            None, 8, AS_OF, "testrail")
    assert (second["id"], second["plan_id"], second["name"], third["id"]) == (2, 9, None, 3)


def test_document_records_gather_custom_fields(spark):
    docs = [(3, '{"id":1,"name":"p","entries":[{"runs":[{"id":5}]}],"custom_a":{"x":1},"custom_b":null,"created_on":60,"other":2}'), (3, '{"id":2}'), (3, "[1]"), (3, None)]
    got = ingest.document_records(spark.createDataFrame(docs, "project_id long, doc string"), "raw_plans")
    assert rows(got, "id", "project_id", "name", "entries", "custom_fields", "created_on") == [
        (1, 3, "p", '[{"runs":[{"id":5}]}]', '{"custom_a":{"x":1},"custom_b":null}', T(1970, 1, 1, 0, 1)), (2, 3, None, None, None, None)]


def test_broken_pages_cost_their_own_cases_only(spark):
    good = '{"cases":[{"id":%d,"suite_id":6,"priority_id":2},{"id":%d}]}'
    pages = [(1, 10, good % (1, 2)), (1, 11, good % (3, 4) + "x"), (2, None, good % (5, 6)), (3, None, '{"error":"denied"}'), (4, None, None),
             (5, None, '{"cases":[]}'), (6, 12, (good % (7, 8))[:-3])]
    df = spark.createDataFrame(pages, "project_id long, suite_id long, body string")
    kept = rows(ingest.cases_from_pages(df), "id", "project_id", "suite_id", "priority_id")
    # a multi-suite fetch stamps its suite, others leave the case's own
    assert [k for k in kept if k[0] not in (3, 4)] == [(1, 1, 10, 2), (2, 1, 10, None), (5, 2, 6, 2), (6, 2, None, None)]
    skipped = {(r["project_id"], r["reason"]) for r in ingest.skipped_pages(df).collect()}
    assert {(3, "no list of cases"), (4, "no response"), (6, "not a page of cases")} <= skipped and (5, "no list of cases") not in skipped
    # every page is either read or listed
    assert ({k[1] for k in kept} | {p for p, _ in skipped} | {5}) == {1, 2, 3, 4, 5, 6}


def test_falsy_scopes_count_as_none(spark):
    state = spark.createDataFrame([("runs", "1", 100, T(2024, 1, 1), "SUCCESS"), ("runs", "2", 300, T(2024, 1, 1), "SUCCESS"),
                                   ("runs", "0", 5, T(2024, 1, 1), "SUCCESS")], S.SYNC_STATE)
    numbers = spark.createDataFrame([(0,), (1,), (None,), (9,)], "p long")
    assert rows(ingest.watermark_read(state, "runs", numbers, "p")) == [(None, 300), ("0", 300), ("1", 100), ("9", 0)]
    names = spark.createDataFrame([("0",), ("",)], "p string")
    assert rows(ingest.watermark_read(state, "runs", names, "p")) == [("", 300), ("0", 5)]
    src = spark.createDataFrame([(0, T(1970, 1, 1, 0, 4)), (0, T(1970, 1, 1, 0, 6))], "project_id long, created_on timestamp_ntz")
    ext = ingest.incremental_extract(src, state, "runs")
    assert rows(ext) == [(0, T(1970, 1, 1, 0, 6))]
    assert rows(ingest.watermark_advance(ext, state, "runs", AS_OF), "scope_id", "last_updated_at_watermark") == [(None, 360)]


def test_watermark_is_monotone_and_merge_is_null_safe(spark):
    state = spark.createDataFrame([("runs", "1", 100, T(2024, 1, 1), "SUCCESS"), ("jira", None, 50, T(2024, 1, 1), "SUCCESS")],
                                  S.SYNC_STATE)
    src = spark.createDataFrame([(1, T(1970, 1, 1, 0, 0, 50)), (1, T(1970, 1, 1, 0, 3, 20)), (2, T(1970, 1, 1, 0, 0, 10))],
                                "project_id long, created_on timestamp_ntz")
    ext = ingest.incremental_extract(src, state, "runs")
    assert rows(ext, "project_id") == [(1,), (2,)]  # project 1 only after 100 s; project 2 has no watermark
    adv = {r["scope_id"]: r["last_updated_at_watermark"] for r in ingest.watermark_advance(ext, state, "runs", AS_OF).collect()}
    assert adv == {"1": 200, "2": 10}
    # an older change never moves the watermark back
    old = spark.createDataFrame([(1, T(1970, 1, 1, 0, 0, 5))], src.schema)
    assert ingest.watermark_advance(old, state, "runs", AS_OF).collect()[0]["last_updated_at_watermark"] == 100
    upd = spark.createDataFrame([("jira", None, 70, AS_OF, "SUCCESS")], S.SYNC_STATE)
    merged = rows(ingest.sync_state_merge(state, upd), "entity_type", "scope_id", "last_updated_at_watermark")
    assert merged == [("jira", None, 70), ("runs", "1", 100)]
    none = ingest.watermark_read(state, "nothing").collect()[0][0]
    assert none == 0


def test_issue_flatten_missing_objects_and_bad_times(spark):
    docs = spark.createDataFrame([
        ('{"id":"1","key":"CM-1","fields":{"summary":"s","status":{"name":"Backlog"},"priority":null,'
         '"created":"2023-01-16T10:39:19.462-0500","updated":"bad"}}',)], "doc string")
    r = ingest.issue_flatten(docs, "https://t").collect()[0]
    assert r["status"] == "Backlog" and r["priority"] is None and r["assignee"] is None
    assert r["created"] == T(2023, 1, 16, 15, 39, 19, 462000) and r["updated"] is None and r["updated_raw"] == "bad"
    assert r["url"] == "https://t/browse/CM-1"


def test_cases_by_suite_mode_and_stamp_parent(spark):
    cases = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (4, 99)], "id long, suite_id long")
    suites = spark.createDataFrame([(10, 1), (20, 2), (30, 3)], "id long, project_id long")
    projects = spark.createDataFrame([(1, 3), (2, None)], "id long, suite_mode long")
    got = rows(ingest.cases_by_suite_mode(cases, suites, projects), "id", "project_id", "suite_id", "suite_mode")
    # project 3 is unknown: its cases are skipped; a missing mode counts as 1; suite 99 has no project
    assert got == [(1, 1, 10, 3), (2, 2, 20, 1)]
    assert rows(ingest.unplaced_cases(cases, suites, projects), "id", "reason") == [(3, "unknown project"), (4, "unknown suite")]
    # a child without a parent stays
    stamped = rows(ingest.stamp_parent(cases, suites, "suite_id"), "id", "project_id")
    assert stamped == [(1, 1), (2, 2), (3, 3), (4, None)]


def test_snapshots_and_counts_cover_every_entity(spark):
    from qalytics.plans.catalog import QUERIES
    from tests.conftest import SF0001

    counts = QUERIES["ingest_counts_all"](spark, SF0001).collect()
    assert {f"raw_{r.entity}" for r in counts} == set(S.BRONZE) and all(r.load is not None and r.rows > 0 for r in counts)
    for name in ("snapshot_load", "snapshot_load_statuses", "snapshot_load_users", "snapshot_load_suites", "snapshot_load_milestones"):
        loads = QUERIES[name](spark, SF0001).select("_extracted_at").distinct().collect()
        assert len(loads) > 1 and (AS_OF,) in loads
