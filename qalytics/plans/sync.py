"""Incremental sync as Spark jobs: landed records → bronze, with per-scope
watermarks kept in a sync-state table.

A sync reads the newest epoch of the commit log (``plans/layout.py``), lands the
records after its watermarks as a load of their own, and commits the load and
the advanced state in one atomic rename. A sync that fails before leaves
nothing visible; of two syncs that start from one epoch, one commits, and the
other starts again from the state that won."""

from __future__ import annotations

import datetime as _dt
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qalytics.operators import ingest
from qalytics.plans import layout as L

ATTEMPTS = 5


def latest_state(spark: SparkSession, root: str) -> tuple[DataFrame, int]:
    """The newest sync state and its epoch (-1 and an empty frame before the
    first sync)."""
    return L.state_at(spark, root)


def bronze(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The committed rows of a bronze table."""
    df = spark.read.parquet(os.path.join(root, "bronze", table))
    return df.where(F.col("load").isin(L.loads(spark, root))).drop("load")


def sync_entity(spark: SparkSession, records: DataFrame, entity: str, table: str, root: str,
                as_of: _dt.datetime, scope_col: str = "project_id") -> dict:
    """One incremental sync of ``entity`` from landed ``records``.

    Returns the number of appended rows, counted as they are written, and the
    new state epoch."""
    shaped = ingest.bronze_append(records, table, as_of)
    for attempt in range(ATTEMPTS):
        state, epoch = latest_state(spark, root)
        load = L.new_load()
        path = os.path.join(root, "bronze", table, f"load={load}")
        changed = ingest.incremental_extract(shaped, state, entity, scope_col)
        count = L.write(changed, path, count=True)
        landed = spark.read.schema(changed.schema).parquet(path)
        advanced = ingest.watermark_advance(landed, state, entity, as_of, scope_col)
        try:
            L.commit(spark, root, epoch + 1, ingest.sync_state_merge(state, advanced), load)
        except L.StateConflict:
            if attempt == ATTEMPTS - 1:
                raise
            continue
        return {"status": "success", "count": count, "epoch": epoch + 1}
