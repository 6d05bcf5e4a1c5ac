"""Incremental landing: new export files in a folder -> bronze/silver/gold.

A Structured Streaming file source tracks which files were already taken
(in its checkpoint), and every micro-batch runs the same ``run_batch`` as
a batch load.  ``trigger(availableNow=True)`` takes what has landed and
stops, so the job can run on a schedule; a continuous trigger works too.

Restarts are safe, and each micro-batch is in the tables once: bronze keeps the
last batch of every stream (by the stream's own id, which its checkpoint holds)
in the same commit as the batch's rows and its quarantined rows.  A batch that
is run again after a failure, by this stream or a copy of it, finds itself there
and only brings silver and gold up to date.  Any number of streams can load into
one set of tables, at the same time too.
"""

from __future__ import annotations

from collections import deque
from threading import Event

from pyspark.sql import DataFrame, SparkSession

from ..config import DEFAULT, AttendanceConfig
from ..plans.batch import BatchResult, Tables, run_batch
from ..sources.files import _cells, by_header, with_file

KEPT_RESULTS = 100   # results of past micro-batches that stay on the driver


def landing_stream(spark: SparkSession, landing: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Rows of landed files as cells; a micro-batch holds whole files, so each
    file's header comes with its rows."""
    r = _cells(spark.readStream)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return with_file(r.csv(landing))


def run_incremental(spark: SparkSession, landing: str, tables: Tables, checkpoint: str,
                    cfg: AttendanceConfig = DEFAULT, available_now: bool = True,
                    max_files_per_trigger: int | None = None, newer_only: bool = False, replace_days: bool = False):
    """Process landed files into the three tables; returns the query handle
    (already finished when ``available_now``) and the latest per-batch results.
    With ``newer_only`` and ``replace_days`` the tables do not depend on how
    files fall into micro-batches or in which order they arrive."""
    results = deque(maxlen=KEPT_RESULTS)
    started, query = Event(), []

    def each(batch: DataFrame, batch_id: int) -> None:
        started.wait()
        results.append((batch_id, take_batch(batch, query[0].id, batch_id, tables, cfg, newer_only, replace_days)))

    w = landing_stream(spark, landing, max_files_per_trigger).writeStream.foreachBatch(each) \
        .option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    query.append(w.start())
    started.set()
    if available_now:
        query[0].awaitTermination()
    return query[0], results


def take_batch(batch: DataFrame, stream: str, batch_id: int, tables: Tables, cfg: AttendanceConfig = DEFAULT,
               newer_only: bool = False, replace_days: bool = False) -> BatchResult:
    """One micro-batch of ``landing_stream`` through the tables, once per (stream, batch)."""
    return run_batch(batch.sparkSession, by_header(batch), tables, cfg, run_id=f"{stream}-{batch_id}",
                     newer_only=newer_only, replace_days=replace_days, load=(stream, batch_id))
