"""A third of all rows on one key: results stay exact when Spark splits the
skewed join partitions (broadcast off, tiny AQE skew thresholds)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from qalytics.operators import conform, marts
from qalytics.session import fresh_shared_path
from tests.conftest import rows

T = dt.datetime
AS_OF = T(2024, 2, 10)
SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture()
def skewed(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def test_hot_run_and_hot_test(skewed):
    spark = skewed
    n = 3000
    # run 0 holds a third of all tests; test 0 holds a third of all results
    tests = spark.range(n).select(
        F.col("id"), F.when(F.col("id") < n // 3, 0).otherwise(F.col("id") % 97 + 1).alias("run_id"),
        (F.col("id") % 50).alias("case_id"), (F.col("id") % 6 + 1).alias("status_id"),
        F.lit(T(2024, 1, 1)).cast("timestamp_ntz").alias("_extracted_at"), F.lit(0.0).alias("_tiebreak"))
    dup = tests.where(F.col("id") % 5 == 0).withColumn("_extracted_at", F.lit(T(2023, 1, 1)).cast("timestamp_ntz"))
    raw_tests = tests.unionByName(dup)
    results = spark.range(n).select(
        F.col("id"), F.when(F.col("id") < n // 3, 0).otherwise(F.col("id") % n).alias("test_id"),
        F.concat(F.lit("CM-"), (F.col("id") % 40).cast("string")).alias("defects"),
        F.lit(None).cast("string").alias("custom_fields"))
    cases = spark.range(50).select(F.col("id"), (F.col("id") % 4 + 1).alias("priority_id"))
    issues = spark.range(40).select(F.concat(F.lit("CM-"), F.col("id").cast("string")).alias("key"),
                                    F.lit("Backlog").alias("status"), F.lit("Alta").alias("priority"),
                                    F.lit(T(2024, 1, 1)).cast("timestamp_ntz").alias("created"))
    stg = spark.range(98).select(F.lit(1).cast("long").alias("plan_id"), F.col("id").alias("run_id"),
                                 F.lit("2024-01").alias("month_key"), F.lit(12).cast("long").alias("project_id"))

    dedup = conform.dedup_latest(raw_tests, order=("_extracted_at", "_tiebreak"))
    assert dedup.count() == n
    texts = conform.result_texts(results)
    rdp = marts.run_defects_priority(texts, dedup, cases)
    rdj = marts.run_defects_jira(texts, dedup, issues, AS_OF)
    got = marts.run_stats(stg, conform.run_test_counts(dedup.withColumn("assignedto_id", F.col("id") % 9)), rdp, rdj)

    for name, df in (("stg", stg), ("t", dedup), ("rdp", rdp), ("rdj", rdj)):
        df.createOrReplaceTempView(f"sk_{name}")
    brute = spark.sql("""
      SELECT r.run_id, count(t.id) AS total_tests, sum(coalesce(rdp.results_with_defects, 0)) AS defects_count,
             sum(coalesce(rdj.jira_defects_count, 0)) AS jira_defects_count
      FROM sk_stg r LEFT JOIN sk_t t ON r.run_id = t.run_id LEFT JOIN sk_rdp rdp ON r.run_id = rdp.run_id
      LEFT JOIN sk_rdj rdj ON r.run_id = rdj.run_id GROUP BY r.run_id""")
    assert rows(got.select(*brute.columns)) == rows(brute)

    # Production reads the deduplicated tests from the written silver table,
    # so both join sides are shuffled and AQE splits the hot test's results.
    # (In the lazy lineage the deduplicated side arrives already partitioned
    # by id and only the results side is shuffled.)
    silver = fresh_shared_path(spark, "skew-silver")
    dedup.write.parquet(silver)
    joined = marts.result_tests(results, spark.read.parquet(silver))
    assert len(joined.collect()) == n  # runs this Dataset's own (adaptive) plan to its final form
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "skew=true" in plan


def test_hot_and_null_plan_keys_are_split_in_staged_runs(skewed):
    spark = skewed
    # a third of the runs on plan 1, a third without a plan
    runs = spark.range(3000).select(
        F.col("id"), F.lit(5).cast("long").alias("project_id"),
        F.when(F.col("id") < 1000, F.lit(1)).when(F.col("id") < 2000, F.lit(None))
        .otherwise(F.col("id") % 50 + 2).cast("long").alias("plan_id"),
        F.concat(F.lit("r"), F.col("id").cast("string")).alias("name"), (F.col("id") % 3).alias("milestone_id"),
        F.lit(T(2024, 1, 1)).cast("timestamp_ntz").alias("created_on"),
        F.lit(None).cast("timestamp_ntz").alias("completed_on"), F.lit(False).alias("is_completed"),
        F.lit(None).cast("long").alias("assignedto_id"))
    plans = spark.range(1, 60).select(
        F.col("id"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("name"),
        F.lit(T(2023, 1, 1)).cast("timestamp_ntz").alias("created_on"),
        F.lit(None).cast("timestamp_ntz").alias("completed_on"), F.lit(False).alias("is_completed"),
        F.lit('{"custom_fechainicio":"2024-02-01"}').alias("custom_fields"))
    milestones = spark.range(3).select(F.col("id"), F.lit("m").alias("name"), F.lit(None).cast("string").alias("custom_fields"))
    stg = conform.stg_runs(runs, plans, milestones)
    got = stg.collect()
    assert len(got) == 3000 and sum(r["on_time_to_qa"] for r in got) == 2000
    assert sum(1 for r in got if r["plan_name"] is None) == 1000
    plan = stg._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin(skew=true)" in plan
