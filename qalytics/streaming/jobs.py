"""Structured Streaming forms of the ingest paths.

* ``microbatch_ingest``: landed files → bronze, a bounded number of files
  per micro-batch, with the offsets in a checkpoint folder below
  ``spark.checkpoint.dir`` so a lost executor or a restarted job resumes
  where it stopped.
* ``velocity_stream``: results per day, as partial counts per micro-batch.

Both sinks write one folder per micro-batch, named by its id: a micro-batch
that is run again after a crash replaces its own folder and nothing else.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from qalytics import config as C
from qalytics.functions import ts_lit
from qalytics.session import fresh_shared_path


def land_files(df: DataFrame, path: str, files: int | None = None, max_records: int | None = None) -> str:
    """Write records as JSON-lines text files (the landing zone), in ``files``
    parts (by default as ``df`` is partitioned) and at most ``max_records``
    per file when given."""
    lines = df.select(F.col(df.columns[0]).alias("value"))
    w = (lines.repartition(files) if files else lines).write.mode("overwrite")
    if max_records:
        w = w.option("maxRecordsPerFile", max_records)
    w.text(path)
    return path


def microbatch_ingest(spark: SparkSession, landed_dir: str, bronze_dir: str,
                      shape: Callable[[DataFrame], DataFrame], files_per_batch: int = 1,
                      checkpoint: str | None = None) -> dict:
    """Stream landed JSON-lines files into a bronze parquet table.

    ``shape`` turns a micro-batch of raw lines (column ``value``) into
    bronze rows, written to ``batch_id=N``. Runs to completion (availableNow)
    and reports the rows (counted by the writes themselves) and micro-batches of this run; a failed stream
    becomes an error status, as in the reference."""
    checkpoint = checkpoint or fresh_shared_path(spark, "ckpt-ingest")
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(landed_dir)
    landed: dict[int, int] = {}

    def write(batch: DataFrame, batch_id: int) -> None:
        path = f"{bronze_dir}/batch_id={batch_id}"
        seen = Observation(f"batch {batch_id}")
        rows = shape(batch).observe(seen, F.count(F.lit(1)).alias("rows"))
        rows.write.mode("overwrite").parquet(path)
        landed[batch_id] = seen.get["rows"]

    try:
        q = (lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
        q.awaitTermination()
    except StreamingQueryException as ex:
        return {"status": "error", "error": str(ex)}
    return {"status": "success", "count": sum(landed.values()), "batches": len(landed)}


def daily_counts(spark: SparkSession, out_dir: str) -> DataFrame:
    """Results per day: the partial counts of all micro-batches together."""
    parts = spark.read.schema("date string, count long, epoch int").parquet(out_dir)
    return parts.groupBy("date").agg(F.sum("count").alias("count"))


def velocity_stream(spark: SparkSession, results: DataFrame, out_dir: str, as_of: _dt.datetime,
                    days: int = C.VELOCITY_WINDOW_DAYS, checkpoint: str | None = None) -> None:
    """Daily result counts from a streaming results frame.

    Each micro-batch counts its own results per day into ``epoch=<batch id>``
    (at most one row per day); ``daily_counts`` adds them up. No state and no
    watermark is kept, so no result is late, however the landed files are
    ordered and whatever lies after ``as_of``."""
    checkpoint = checkpoint or fresh_shared_path(spark, "ckpt-velocity")
    start = ts_lit(as_of - _dt.timedelta(days=days))

    def count(batch: DataFrame, batch_id: int) -> None:
        (batch.where(F.col("created_on") >= start).groupBy(F.date_format("created_on", "yyyy-MM-dd").alias("date"))
         .agg(F.count(F.lit(1)).alias("count")).write.mode("overwrite").parquet(f"{out_dir}/epoch={batch_id}"))

    q = (results.writeStream.foreachBatch(count)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
