"""A newest-row table kept up to date by a stream.

Each micro-batch reads only the key ranges that its rows fall into, merges its
rows with theirs (newest by ``order``, ties by a hash of the whole row) and
replaces these ranges. The outcome equals the batch form over all rows,
whatever the batches and their order, and a row that comes twice changes nothing.

A micro-batch writes its ranges aside, below the stream's own checkpoint, and
then over the table: one that died half way is repeated from there. The table
has one writer. No state is kept between micro-batches, so nothing is late;
names of ranges reach the driver, rows never do.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qalytics.operators import conform
from qalytics.plans import layout as L
from qalytics.session import folder_names, fresh_shared_path, path_exists, remove_path

KEY_RANGE = "key_range"


def newest_rows(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table's rows, with the columns of ``like`` (none before its first batch)."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], like.schema)
    return L.read(spark, path, lambda: spark.createDataFrame([], like.schema)).select(*like.columns)


def newest_rows_stream(spark: SparkSession, rows: DataFrame, path: str, span: int, key: str = "id",
                       order: tuple[str, ...] = ("_extracted_at",), checkpoint: str | None = None) -> None:
    """Merge a streaming frame into the newest-row table at ``path``,
    partitioned by ranges of ``span`` keys. Runs to completion (availableNow)."""
    checkpoint = checkpoint or fresh_shared_path(spark, "ckpt-newest")
    split = L.Split(KEY_RANGE, f"{key} DIV {span}")
    work = os.path.join(checkpoint, "aside")

    def merge(batch: DataFrame, batch_id: int) -> None:
        aside = os.path.join(work, f"batch={batch_id}")
        for folder in folder_names(spark, work) if path_exists(spark, work) else ():
            if folder != f"batch={batch_id}":  # committed before this one began
                remove_path(spark, os.path.join(work, folder))
        new = conform.dedup_latest(batch, key, order, pinned=True)
        parts = [r[0] for r in batch.select(F.expr(split.value).alias("v")).distinct().collect()]

        def merged() -> DataFrame:
            if not path_exists(spark, path):
                return new
            held = L.read(spark, path, lambda: new.withColumn(KEY_RANGE, F.expr(split.value)))
            old = held.where(L.in_parts(KEY_RANGE, parts)).select(*batch.columns)  # prunes folders
            return conform.dedup_latest(old.unionByName(new), key, order, pinned=True)

        if parts:
            L.overwrite_parts(spark, merged, path, split, parts, aside)

    q = rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
