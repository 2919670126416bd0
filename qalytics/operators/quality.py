"""Data-quality checks; each returns one ``(check_name, failures)`` row."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qalytics import config as C
from qalytics.functions import ts_lit


def _result(name: str, failures: DataFrame) -> DataFrame:
    return failures.agg(F.count(F.lit(1)).alias("failures")).select(F.lit(name).alias("check_name"), "failures")


def dq_duplicate_runs(raw_runs: DataFrame) -> DataFrame:
    dup = raw_runs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return _result(C.DQ_DUPLICATE_RUNS, dup)


def dq_future_dates(raw_runs: DataFrame, as_of: _dt.datetime) -> DataFrame:
    return _result(C.DQ_FUTURE_DATES, raw_runs.where(F.col("created_on") > ts_lit(as_of)))


def dq_negative_counts(raw_runs: DataFrame) -> DataFrame:
    return _result(C.DQ_NEGATIVE_COUNTS, raw_runs.where((F.col("passed_count") < 0) | (F.col("failed_count") < 0)))


def dq_start_after_end(fact: DataFrame) -> DataFrame:
    """Closed cycles whose start date lies after their completion date.
    ``fact`` needs eff_start_date, completed_on and is_closed."""
    bad = fact.where((F.col("eff_start_date") > F.to_date("completed_on")) & (F.col("is_closed") == F.lit(True)))
    return _result(C.DQ_START_AFTER_END, bad)


def data_quality(raw_runs: DataFrame, fact: DataFrame, as_of: _dt.datetime) -> DataFrame:
    """All four checks as one frame."""
    return (dq_duplicate_runs(raw_runs)
            .unionByName(dq_future_dates(raw_runs, as_of))
            .unionByName(dq_negative_counts(raw_runs))
            .unionByName(dq_start_after_end(fact)))
