"""Streaming queries over data derived from the provided tables.

Each lands its input into a fresh folder below ``spark.checkpoint.dir``,
runs the stream to completion (availableNow) and returns the sink's
content as a batch DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame

from qalytics.operators import ingest
from qalytics.plans import layout as L
from qalytics.plans.relations import Relations
from qalytics.session import fresh_shared_path
from qalytics.sources.landed import TRACKER_URL
from qalytics.streaming import jobs, newest


def issue_microbatch(rel: Relations, files: int | None = None, issues_per_file: int = 100_000,
                     files_per_batch: int = 1000) -> DataFrame:
    """Tracker issues landed as JSON-lines files, appended to bronze in
    micro-batches of ``files_per_batch`` files."""
    spark = rel.spark
    landed = jobs.land_files(rel.landed.issue_docs, fresh_shared_path(spark, "landing-issues"), files,
                             max_records=issues_per_file)
    bronze = fresh_shared_path(spark, "bronze-raw_jira_issues")

    def shape(batch: DataFrame) -> DataFrame:
        flat = ingest.issue_flatten(batch.withColumnRenamed("value", "doc"), TRACKER_URL)
        return ingest.bronze_append(flat, "raw_jira_issues", rel.as_of)

    status = jobs.microbatch_ingest(spark, landed, bronze, shape, files_per_batch=files_per_batch)
    if status["status"] != "success":
        raise RuntimeError(status.get("error"))
    return spark.read.parquet(bronze).drop("batch_id")


def velocity_stream(rel: Relations, files: int | None = None, files_per_batch: int = 1000) -> DataFrame:
    """Results per day over the last 30 days, counted per micro-batch over
    landed result files."""
    spark = rel.spark
    landing = fresh_shared_path(spark, "landing-results")
    results = rel.bronze.raw_results
    (results.repartitionByRange(files, "created_on") if files else results).write.parquet(landing)
    stream = spark.readStream.schema(results.schema).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    out = fresh_shared_path(spark, "velocity")
    jobs.velocity_stream(spark, stream, out, rel.as_of)
    return jobs.daily_counts(spark, out).orderBy("date")


def dedup_latest_stream(rel: Relations, files: int | None = None, files_per_batch: int = 1000,
                        span: int = L.KEY_SPANS["dedup_tests"]) -> DataFrame:
    """The newest row per test, merged per micro-batch over landed files of tests."""
    spark = rel.spark
    landing = fresh_shared_path(spark, "landing-tests")
    tests = rel.bronze.raw_tests
    (tests.repartition(files) if files else tests).write.parquet(landing)
    stream = spark.readStream.schema(tests.schema).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    out = fresh_shared_path(spark, "newest-tests")
    newest.newest_rows_stream(spark, stream, out, span, order=("_extracted_at", "_tiebreak"))
    return newest.newest_rows(spark, out, tests)
