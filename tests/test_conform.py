import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from qalytics.operators import conform
from tests.conftest import rows

T = dt.datetime


def test_dedup_latest_keeps_newest_and_tiebreak(spark):
    df = spark.createDataFrame([
        (1, "old", T(2024, 1, 1), 1.0), (1, "new", T(2024, 1, 2), 0.0),
        (2, "lo", T(2024, 1, 1), 1.0), (2, "hi", T(2024, 1, 1), 5.0),
        (3, "null-ts", None, 9.0), (3, "ts", T(2020, 1, 1), 0.0),
    ], "id long, v string, _extracted_at timestamp_ntz, _tiebreak double")
    got = rows(conform.dedup_latest(df, order=("_extracted_at", "_tiebreak")), "id", "v")
    assert got == [(1, "new"), (2, "hi"), (3, "ts")]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 10_000)), min_size=1, max_size=40, unique_by=lambda t: t[1]))
def test_dedup_idempotent_and_order_independent(spark, recs):
    data = [(k, T(2024, 1, 1) + dt.timedelta(seconds=s), f"v{s}") for k, s in recs]
    df = spark.createDataFrame(data, "id long, _extracted_at timestamp_ntz, v string")
    once = conform.dedup_latest(df)
    twice = conform.dedup_latest(once)
    shuffled = conform.dedup_latest(spark.createDataFrame(list(reversed(data)), df.schema))
    expect = {}
    for k, ts, v in data:
        if k not in expect or ts > expect[k][0]:
            expect[k] = (ts, v)
    assert rows(once, "id", "v") == sorted((k, v) for k, (_, v) in expect.items())
    assert rows(once) == rows(twice) == rows(shuffled)


def _stg(spark, runs, plans, milestones):
    r = spark.createDataFrame(runs, "id long, project_id long, plan_id long, name string, milestone_id long, "
                                    "created_on timestamp_ntz, completed_on timestamp_ntz, is_completed boolean, assignedto_id long")
    p = spark.createDataFrame(plans, "id long, name string, created_on timestamp_ntz, completed_on timestamp_ntz, "
                                     "is_completed boolean, custom_fields string")
    m = spark.createDataFrame(milestones, "id long, name string, custom_fields string")
    return {x["run_id"]: x for x in conform.stg_runs(r, p, m).collect()}


def test_stg_runs_on_time_blocked_last_cycle_deviation(spark):
    runs = [
        # plan 10 has a parsed start and due date
        (1, 5, 10, "r1", 0, T(1998, 5, 1), T(1999, 1, 1), True, 1),
        (2, 5, 10, "r2", 0, T(1998, 7, 1), T(1999, 7, 1), True, 1),
        # plan 20 has no start key, milestone 0 has one → blocked; no parsed start → on_time_to_qa 0
        (3, 5, 20, "r3", 0, T(1998, 1, 1), None, False, 2),
        # project 12 runs do not define the plan's last date
        (4, 12, 20, "r4", 0, T(2001, 1, 1), None, False, 2),
        # standalone run: no plan
        (5, 5, None, "r5", 1, T(1998, 1, 1), None, False, None),
    ]
    plans = [
        (10, "P10", T(1998, 1, 1), T(1999, 1, 1), True,
         '{"custom_fecha_de_inicio":"1998-06-01","custom_fecha_de_finalizacion":"1999-06-01","custom_acta_de_certificacin":"A1"}'),
        (20, "P20", T(1998, 1, 1), None, False, '{"custom_fecha_de_inicio":{"nested":1}}'),
    ]
    milestones = [(0, "M0", '{"custom_fechainicio":"1998-01-01"}'), (1, "M1", None)]
    s = _stg(spark, runs, plans, milestones)
    assert (s[1]["on_time_to_qa"], s[2]["on_time_to_qa"]) == (1, 0)
    assert (s[1]["on_time_from_qa"], s[2]["on_time_from_qa"]) == (1, 0)
    assert s[1]["acta_certificacion"] == "A1" and s[1]["eff_plan_start_on"] == T(1998, 6, 1)
    # object-valued key is not a scalar: no start date, plan falls back to its own dates
    assert s[3]["on_time_to_qa"] == 0 and s[3]["eff_plan_start_on"] == T(1998, 1, 1)
    assert s[3]["is_blocked"] == 1 and s[1]["is_blocked"] == 0 and s[5]["is_blocked"] == 0
    # last cycle of plan 10 is r2 (completed 1999-07-01); r4 (project 12) is not considered
    assert (s[1]["is_last_cycle"], s[2]["is_last_cycle"]) == (0, 1)
    assert s[3]["is_last_cycle"] == 1 and s[4]["is_last_cycle"] == 0 and s[5]["is_last_cycle"] == 0
    # deviation: created − parsed start, whole days; no parsed start → created − created = 0
    assert s[1]["desviacion_inicio"] == -31 and s[2]["desviacion_inicio"] == 30 and s[3]["desviacion_inicio"] == 0
    assert s[5]["month_key"] == "1998-01" and s[5]["plan_name"] is None


def test_fact_cycle_gating(spark):
    runs = spark.createDataFrame([
        (1, 17, None, "c1", T(2024, 1, 1), T(2024, 1, 15), True, 10, 0, 1, 0, 0),
        (2, 17, None, "c2", T(2024, 1, 1), T(2024, 1, 16), True, 10, 0, 0, 0, None),
        (3, 23, None, "c3", T(2024, 1, 1), None, False, 19, 1, 0, 0, 0),
        (4, 5, None, "c4", T(2024, 1, 1), T(2024, 1, 2), True, 3, 0, 0, 0, 0),
    ], "id long, project_id long, plan_id long, name string, created_on timestamp_ntz, completed_on timestamp_ntz, "
       "is_completed boolean, passed_count long, failed_count long, blocked_count long, retest_count long, untested_count long")
    plans = spark.createDataFrame([], "id long, name string")
    f = {r["cycle_id"]: r for r in conform.fact_cycle(runs, plans).collect()}
    assert f[1]["on_time_end"] is True and f[2]["on_time_end"] is False  # 14-day limit
    assert f[1]["is_blocked"] is True and f[1]["total_tests"] == 11
    assert f[2]["total_tests"] is None  # a NULL count makes the total NULL
    assert f[3]["uat_certified"] is True and f[3]["passed_count"] == 0  # gated to project 17
    assert f[4]["on_time_start"] is None and f[1]["on_time_start"] is True
    assert f[4]["on_time_end"] is False and f[4]["uat_certified"] is False


def test_defect_keys_every_match_whole_text(spark):
    long_text = "x" * 50_000 + " CM-7 "
    df = spark.createDataFrame([(1, 11, "CM-1, CM-22 and CM-1"), (2, 12, ""), (3, 13, None), (4, 14, long_text)],
                               "id long, test_id long, defects string")
    got = rows(conform.defect_keys(df), "id", "defect_key")
    assert got == [(1, "CM-1"), (1, "CM-1"), (1, "CM-22"), (4, "CM-7")]
