"""Folders of a written build: partitioned tables, loads and the commit log.

A build folder holds

* ``bronze/<table>/load=<token>``: one folder per load, never changed after;
* ``commits/epoch=<n>``: the commit log. An epoch names the load it adds and
  holds the sync state after it. It is written aside and renamed into place,
  which fails if the epoch exists: of two writers that start from one epoch,
  one wins, and the other's load is never seen by a reader;
* ``silver``, ``gold``, ``mart``: one folder per table, those that a refresh
  changes in part partitioned by a range of their key;
* ``refreshed/epoch=<n>``: the epochs that the layers contain.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from qalytics import schemas as S
from qalytics.session import folder_names, path_exists, remove_path, rename_new

NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class Split:
    """How a table is partitioned: ``column`` holds ``value``; rows are dealt
    to the writing tasks by ranges of ``spread`` (sampled, so one dominant
    value is split over tasks), or, without it, by the partition itself."""

    column: str
    value: str
    spread: tuple[str, ...] = ()


# Ids that one key range of a silver table spans. Ids grow with time, so new
# and changed rows meet few ranges; a range is what a refresh rewrites.
KEY_SPANS = {"dedup_tests": 1 << 22, "dedup_runs": 1 << 18, "dedup_plans": 1 << 18, "dedup_cases": 1 << 20, "runs": 1 << 18}
RUN_TABLES = ("stg_runs_wide", "run_test_counts", "run_defects_priority", "run_defects_jira")


def splits(spans: dict[str, int]) -> dict[str, Split]:
    out = {
        "raw_results": Split("created_date", "to_date(created_on)", ("created_on", "id")),
        # by month: a day of runs is a handful of rows
        "raw_runs": Split("created_month", "date_format(created_on, 'yyyy-MM')", ("created_on", "id")),
        # the second column splits a dominant (or missing) day
        "fact_cycle": Split("month_key", "month_key", ("eff_start_date", "cycle_id")),
        "dashboard_mart": Split("project_part", "project_id"),
    }
    out.update({t: Split("key_range", f"id DIV {n}") for t, n in spans.items() if t != "runs"})
    out.update({t: Split("run_range", f"run_id DIV {spans['runs']}") for t in RUN_TABLES})
    return out


# Partition columns that no relation has: readers drop them.
ADDED_COLUMNS = ("load", "created_date", "created_month", "key_range", "run_range", "project_part")


def arrange(df: DataFrame, split: Split | None) -> DataFrame:
    if split is None:
        return df
    df = df.withColumn(split.column, F.expr(split.value))
    if split.spread:
        return df.repartitionByRange(*split.spread).sortWithinPartitions(*split.spread)
    return df.repartition(split.column)


def write(df: DataFrame, path: str, split: Split | None = None, count: bool = False) -> int | None:
    """Write a table; with ``count`` the rows are counted as they are written."""
    df = arrange(df, split)
    seen = Observation("written")
    if count:
        df = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    (w.partitionBy(split.column) if split else w).parquet(path)
    return seen.get["rows"] if count else None


def in_parts(value: str, parts: list) -> Column:
    """Rows whose partition value is among ``parts`` (None is one of them)."""
    c = F.expr(value)
    known = [p for p in parts if p is not None]
    cond = c.isin(known) if known else F.lit(False)
    return cond | c.isNull() if None in parts else cond


def overwrite_parts(spark: SparkSession, make, path: str, split: Split, parts: list, aside: str) -> None:
    """Rewrite the partitions ``parts`` of a table with the rows of ``make()``,
    which holds theirs and no others. The rows are first written ``aside``:
    ``make`` may read the table itself, and a run that died half way finds them
    there and only repeats the overwrite. Partitions left without rows go."""
    if not path_exists(spark, os.path.join(aside, "_SUCCESS")):
        write(make(), aside, split)
    if folder_names(spark, aside):
        (spark.read.parquet(aside).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(split.column).parquet(path))
    kept = set(folder_names(spark, aside))
    for p in parts:
        folder = f"{split.column}={NULL_PARTITION if p is None else p}"
        if folder not in kept:
            remove_path(spark, os.path.join(path, folder))


def read(spark: SparkSession, path: str, empty) -> DataFrame:
    """A written table. A partitioned table without any row has no file that
    tells its columns: then ``empty()`` gives them."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as ex:
        if ex.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return empty().where(F.lit(False))


# ------------------------------------------------------------ commits
class StateConflict(RuntimeError):
    """Another writer committed the epoch first."""


def new_load() -> str:
    return f"l-{uuid.uuid4().hex[:12]}"


def epochs(spark: SparkSession, root: str, log: str = "commits") -> list[int]:
    return sorted(int(n.split("=")[1]) for n in folder_names(spark, os.path.join(root, log)) if n.startswith("epoch="))


def loads(spark: SparkSession, root: str, first: int = 0, last: int | None = None) -> list[str]:
    """Load tokens of the committed epochs ``first`` to ``last``, in order."""
    found = [e for e in epochs(spark, root) if e >= first and (last is None or e <= last)]
    if not found:
        return []
    paths = [os.path.join(root, "commits", f"epoch={e}", "load") for e in found]
    # one row an epoch
    rows = spark.read.schema("epoch long, load string").parquet(*paths).collect()
    return [r["load"] for r in sorted(rows, key=lambda r: r["epoch"])]


def state_at(spark: SparkSession, root: str) -> tuple[DataFrame, int]:
    """The newest sync state and its epoch (-1 and no rows before the first)."""
    found = epochs(spark, root)
    if not found:
        return spark.createDataFrame([], S.SYNC_STATE), -1
    path = os.path.join(root, "commits", f"epoch={found[-1]}", "state")
    return spark.read.schema(S.SYNC_STATE).parquet(path), found[-1]


def commit(spark: SparkSession, root: str, epoch: int, state: DataFrame, load: str) -> None:
    """Add ``epoch`` with its load and state, or raise ``StateConflict``."""
    aside = os.path.join(root, "aside", uuid.uuid4().hex)
    state.select(*[f.name for f in S.SYNC_STATE.fields]).write.parquet(os.path.join(aside, "state"))
    spark.createDataFrame([(epoch, load)], "epoch long, load string").coalesce(1).write.parquet(os.path.join(aside, "load"))
    if not rename_new(spark, aside, os.path.join(root, "commits", f"epoch={epoch}")):
        remove_path(spark, aside)
        raise StateConflict(f"epoch {epoch} of {root} is taken")
