"""Two consecutive incremental syncs: the second appends only newer rows and
watermarks never move back."""

import datetime as dt

from pyspark.sql import functions as F

from qalytics.plans import layout, sync
from qalytics.plans.sync import latest_state, sync_entity
from qalytics.session import fresh_shared_path

T = dt.datetime


def _runs(spark, rows):
    return spark.createDataFrame(rows, "id long, project_id long, name string, created_on long, updated_on long")


def test_incremental_sync_round_trip(spark):
    root = fresh_shared_path(spark, "sync-test")
    first = _runs(spark, [(1, 4, "a", 100, 150), (2, 4, "b", 100, None), (3, 8, "c", 300, 300)])
    r1 = sync_entity(spark, first, "runs", "raw_runs", root, T(2024, 1, 1))
    assert r1 == {"status": "success", "count": 3, "epoch": 0}
    state, epoch = latest_state(spark, root)
    assert dict((r["scope_id"], r["last_updated_at_watermark"]) for r in state.collect()) == {"4": 150, "8": 300}
    # second pull: id 1 updated later, id 3 unchanged, a new run in project 4
    second = _runs(spark, [(1, 4, "a2", 100, 200), (3, 8, "c", 300, 300), (4, 4, "d", 120, 120)])
    r2 = sync_entity(spark, second, "runs", "raw_runs", root, T(2024, 1, 2))
    assert r2["count"] == 1 and r2["epoch"] == 1  # only id 1 changed after watermark 150
    state, _ = latest_state(spark, root)
    wm = dict((r["scope_id"], r["last_updated_at_watermark"]) for r in state.collect())
    assert wm == {"4": 200, "8": 300}
    bronze = sync.bronze(spark, root, "raw_runs")
    assert bronze.count() == 4 and bronze.where(F.col("id") == 1).count() == 2


def test_two_syncs_from_one_epoch_cannot_both_win(spark, monkeypatch):
    root = fresh_shared_path(spark, "sync-race")
    sync_entity(spark, _runs(spark, [(1, 4, "a", 100, 150)]), "runs", "raw_runs", root, T(2024, 1, 1))
    commit = layout.commit
    raced = []

    def slower(spark_, root_, epoch, state, load):
        if not raced:  # another sync commits between this one's read and its commit
            raced.append(epoch)
            monkeypatch.setattr(layout, "commit", commit)
            other = _runs(spark, [(2, 4, "b", 160, 160), (3, 8, "c", 10, 10)])
            assert sync_entity(spark, other, "runs", "raw_runs", root, T(2024, 1, 2))["epoch"] == 1
        commit(spark_, root_, epoch, state, load)

    monkeypatch.setattr(layout, "commit", slower)
    mine = _runs(spark, [(2, 4, "b", 160, 160), (4, 4, "d", 170, 170)])
    report = sync_entity(spark, mine, "runs", "raw_runs", root, T(2024, 1, 3))
    # the loser starts again from the state that won: run 2 is not landed twice
    assert raced == [1] and report == {"status": "success", "count": 1, "epoch": 2}
    assert sorted(r["id"] for r in sync.bronze(spark, root, "raw_runs").collect()) == [1, 2, 3, 4]
    state, _ = latest_state(spark, root)
    assert {r["scope_id"]: r["last_updated_at_watermark"] for r in state.collect()} == {"4": 170, "8": 10}
