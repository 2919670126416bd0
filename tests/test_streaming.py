from qalytics.plans import Relations, streams
from tests.conftest import SF0001, rows


def test_microbatch_ingest_lands_every_issue(spark):
    rel = Relations(spark, SF0001)
    landed = streams.issue_microbatch(rel, files=3)
    assert landed.count() == rel.landed.issue_docs.count()
    assert landed.where("created IS NULL").count() == rel.landed.issue_docs.where("doc LIKE '%n/a%'").count()


def test_counts_cover_this_run_and_a_replay_replaces_its_batch(spark, tmp_path):
    from qalytics.streaming import jobs

    landing, bronze, ckpt = (str(tmp_path / x) for x in ("landing", "bronze", "ckpt"))
    shape = lambda b: b.select("value")
    spark.createDataFrame([("a",), ("b",)], "value string").coalesce(1).write.text(landing)
    assert jobs.microbatch_ingest(spark, landing, bronze, shape, checkpoint=ckpt)["count"] == 2
    spark.createDataFrame([("c",)], "value string").coalesce(1).write.mode("append").text(landing)
    assert jobs.microbatch_ingest(spark, landing, bronze, shape, checkpoint=ckpt)["count"] == 1
    assert rows(spark.read.parquet(bronze), "value") == [("a",), ("b",), ("c",)]
    (tmp_path / "ckpt" / "commits" / "1").unlink()  # as after a crash before the commit
    (tmp_path / "ckpt" / "commits" / ".1.crc").unlink()
    jobs.microbatch_ingest(spark, landing, bronze, shape, checkpoint=ckpt)
    assert rows(spark.read.parquet(bronze), "value") == [("a",), ("b",), ("c",)]


def test_velocity_stream_keeps_days_after_newer_ones(spark, tmp_path):
    import datetime as dt

    from qalytics.streaming import jobs

    landing = str(tmp_path / "landing")
    for day in ("2024-04-20", "2024-04-21", "2024-01-20"):
        (spark.sql(f"SELECT TIMESTAMP_NTZ'{day} 10:00:00' AS created_on").coalesce(1).write.mode("append").parquet(landing))
    stream = spark.readStream.schema("created_on timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(landing)
    out = str(tmp_path / "out")
    jobs.velocity_stream(spark, stream, out, dt.datetime(2024, 2, 10))
    assert [r[0] for r in rows(jobs.daily_counts(spark, out))] == ["2024-01-20", "2024-04-20", "2024-04-21"]


def test_velocity_stream_equals_batch(spark):
    rel = Relations(spark, SF0001)
    assert rows(streams.velocity_stream(rel, files=3)) == rows(rel.velocity_daily)


def test_newest_rows_stream_equals_batch(spark):
    rel = Relations(spark, SF0001)
    assert rows(streams.dedup_latest_stream(rel, files=4, files_per_batch=1, span=4096)) == rows(rel.dedup_tests)


def test_newest_rows_do_not_depend_on_the_batches(spark, tmp_path):
    from qalytics.operators import conform
    from qalytics.streaming import newest

    kind = "id long, _extracted_at int, v string"
    # ties on the stamp, repeats, a null id, a null stamp, ids of several ranges
    parts = [[(1, 5, "a"), (2, 1, "b"), (25, 1, "c"), (None, 1, "n")], [(1, 5, "z"), (1, 4, "old"), (None, 2, "m")],
             [(2, None, "x"), (25, 3, "d"), (25, 3, "e"), (1, 5, "a")], [(40, 1, None)]]
    want = rows(conform.dedup_latest(spark.createDataFrame(sum(parts, []), kind), pinned=True))
    for name, order in (("one", parts), ("other", parts[::-1])):
        landing, out = str(tmp_path / name / "landing"), str(tmp_path / name / "out")
        table = lambda: newest.newest_rows(spark, out, spark.createDataFrame([], kind))
        stream = lambda: spark.readStream.schema(kind).parquet(landing)
        ckpt = str(tmp_path / name / "ckpt")
        assert table().count() == 0
        for part in order:
            spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(landing)
            newest.newest_rows_stream(spark, stream(), out, span=10, checkpoint=ckpt)
        assert rows(table()) == want
        # as after a crash before the last batch was committed: it runs again
        (tmp_path / name / "ckpt" / "commits" / "3").unlink()
        (tmp_path / name / "ckpt" / "commits" / ".3.crc").unlink()
        newest.newest_rows_stream(spark, stream(), out, span=10, checkpoint=ckpt)
        assert rows(table()) == want


def test_newest_rows_leave_other_ranges_alone(spark, tmp_path):
    from qalytics.streaming import newest

    landing, out, ckpt = (str(tmp_path / x) for x in ("landing", "out", "ckpt"))
    kind = "id long, _extracted_at int"
    files = lambda k: sorted(p.name for p in (tmp_path / "out" / f"key_range={k}").glob("*.parquet"))

    def merge(data):
        spark.createDataFrame(data, kind).coalesce(1).write.mode("append").parquet(landing)
        newest.newest_rows_stream(spark, spark.readStream.schema(kind).parquet(landing), out, span=10, checkpoint=ckpt)

    merge([(1, 1), (11, 1)])
    before = files(0), files(1)
    merge([(12, 1), (11, 0)])
    assert files(0) == before[0] and files(1) != before[1]
    assert rows(newest.newest_rows(spark, out, spark.createDataFrame([], kind))) == [(1, 1), (11, 1), (12, 1)]
