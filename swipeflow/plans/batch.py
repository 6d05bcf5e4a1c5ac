"""One load of swipe exports through bronze, silver and gold.

``run_batch`` is the Spark-side equivalent of the reference's per-file
pipeline, but for any number of files at once:

raw -> clean -> upsert bronze -> what changed there -> upsert silver -> what
changed there -> recompute every *whole* work day that holds a change -> upsert
gold.

Silver and gold follow the change feed of the table before them: each of their
versions says up to which version of that table it was derived, so the next load
takes in all that came since, also what an interrupted load left behind.  A load
of known rows changes no table and computes no day.

Work days: a swipe before the 05:00 cut-off belongs to the previous day, so
a batch starting on day D can change day D-1.  The affected (employee, work
day) pairs are those of every swipe that was inserted or changed, whatever its
status (a swipe re-sent as ``Rejected`` still triggers a rebuild); silver is
read for those days and the days after them, so every affected day is rebuilt
from all of its swipes, not from the fragment in this batch.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, AttendanceConfig
from ..functions.columns import swipe_timestamp, work_date
from ..operators.attendance import gold_attendance, minutes_as_integers
from ..operators.clean import classified
from ..operators.conform import silver_cast
from ..operators import versions
from ..operators.upsert import (ACTIONS, OLD, TRIES, UpsertResult, change_feed, fed_partitions, observed,
                                partition_values, read_table, upsert)
from ..operators.versions import LOAD, Conflict, Version
from ..schemas import BRONZE_KEYS, GOLD_KEYS, GOLD_SCHEMA, SILVER_KEYS, SILVER_SCHEMA
from ..session import materialize, remove_path, work_path
from ..sources.files import write_file_reports, write_report

MAX_DAYS = 100_000   # days a batch may touch; more is refused
REJECTED = "source_file string, reason string, row string, run_id string"


@dataclass
class Tables:
    bronze: str
    silver: str
    gold: str
    quarantine: str | None = None    # default: beside bronze

    @property
    def rejects(self) -> str:
        return self.quarantine or self.bronze.rstrip("/") + "_quarantine"


@dataclass
class BatchResult:
    start_date: object
    end_date: object
    counts: dict = field(default_factory=dict)
    report: str | None = None


def affected_days(rows: DataFrame, cfg: AttendanceConfig = DEFAULT) -> DataFrame:
    """(Employee_No, work_date) of the given silver/bronze-shaped rows."""
    ts = swipe_timestamp(F.col("Date"), F.col("time"))
    wd = F.coalesce(work_date(ts, cfg), F.col("Date"))
    return rows.select("Employee_No", wd.alias("work_date")).distinct()


def within_days(days: list) -> list:
    if len(days) > MAX_DAYS:
        raise ValueError(f"more than {MAX_DAYS} days in one load; load fewer at once")
    return sorted(days)


def read_rejects(spark: SparkSession, tables: Tables) -> DataFrame:
    """Rows that could not be read (file, reason, the row as it came, run id):
    those of the loads that are in bronze."""
    found = versions.current(spark, tables.bronze).rejects
    if not found:
        return spark.createDataFrame([], REJECTED)
    return spark.read.schema(REJECTED).parquet(*[f"{tables.rejects}/{LOAD}={r}" for r in found])


def refresh_gold(spark: SparkSession, tables: Tables, days: DataFrame,
                 cfg: AttendanceConfig = DEFAULT, replace_days: bool = False, silver: Version | None = None,
                 base: Version | None = None, dates: list | None = None) -> dict:
    """Recompute whole affected work days from silver and upsert them.

    ``days`` (Employee_No, work_date; cheap to read, it is read three times)
    limits the swipes before they are windowed, and its set of days, not their
    span, limits what is read.  By default a day that no longer has any counted
    swipe keeps its old gold row (no delete arm); with ``replace_days`` the
    recomputed days replace their gold rows wholesale, deleting such rows.
    ``silver``, ``base``: versions that silver is read at and that gold had then;
    ``dates``: the days' dates, if known.
    """
    dates = partition_values(days, "work_date", MAX_DAYS) if dates is None else dates
    took = silver.number if silver else None
    if not dates and not took:
        return dict.fromkeys(ACTIONS, 0)
    calendar = sorted({*dates, *(d + dt.timedelta(days=1) for d in dates)})
    rows = read_table(spark, tables.silver, SILVER_SCHEMA, partitions=calendar, version=took)
    fresh = gold_attendance(rows.where(F.col("Date").isin(calendar)), cfg, only=days)
    return upsert(spark, tables.gold, fresh, GOLD_KEYS, "work_date", schema=GOLD_SCHEMA, partitions=dates,
                  unique_keys=True, scope=days if replace_days else None, took=took, base=base).counts


def _followed(attempt) -> dict:
    """Counts of ``attempt``, tried again where another load came first."""
    for _ in range(TRIES):
        try:
            return attempt()
        except Conflict:
            continue
    raise RuntimeError(f"{TRIES} other loads came first")


def advance_silver(spark: SparkSession, tables: Tables) -> dict:
    """Take into silver what changed in bronze since its last version."""
    def attempt():
        # silver's version first: if another load takes in more, this one conflicts and looks again
        v, up = versions.current(spark, tables.silver), versions.current(spark, tables.bronze)
        if up.number <= v.took:
            return dict.fromkeys(ACTIONS, 0)
        rows = change_feed(spark, tables.bronze, v.took, up.number)
        if len(versions.feeds(spark, tables.bronze, v.took, up.number)) > 1:       # the last row of each key
            rest = [f"`{c}`" for c in rows.columns if c not in BRONZE_KEYS]
            rows = rows.groupBy(*BRONZE_KEYS).agg(F.max_by(F.struct(*rest), F.col(LOAD)).alias("_r")).select(*BRONZE_KEYS, "_r.*")
        # bronze keys map one-to-one onto silver keys: no second reduction
        return upsert(spark, tables.silver, silver_cast(rows), SILVER_KEYS, "Date", schema=SILVER_SCHEMA,
                      partitions=fed_partitions(spark, tables.bronze, v.took, up.number), unique_keys=True,
                      took=up.number, base=v).counts
    return _followed(attempt)


def changed_days(spark: SparkSession, tables: Tables, after: int, upto: int, cfg: AttendanceConfig = DEFAULT) -> DataFrame:
    """(Employee_No, work_date) of swipes that silver's versions in (after, upto] changed, as they were and as they are."""
    feed = change_feed(spark, tables.silver, after, upto)
    was = feed.where(F.col(OLD).isNotNull()).select("Employee_No", f"{OLD}.Date", f"{OLD}.time")
    return affected_days(feed.select("Employee_No", "Date", "time").union(was), cfg)


def advance_gold(spark: SparkSession, tables: Tables, cfg: AttendanceConfig = DEFAULT, replace_days: bool = False) -> dict:
    """Recompute the work days of all swipes that changed in silver since gold's last version."""
    def attempt():
        v, up = versions.current(spark, tables.gold), versions.current(spark, tables.silver)
        if up.number <= v.took:
            return dict.fromkeys(ACTIONS, 0)
        seen, path = Observation("days"), work_path(spark, "days")
        days = changed_days(spark, tables, v.took, up.number, cfg)
        days.observe(seen, F.collect_set("work_date").alias("dates")).write.parquet(path)
        dates = within_days(observed(seen).get("dates", []))
        try:
            return refresh_gold(spark, tables, spark.read.schema(days.schema).parquet(path), cfg, replace_days, up, v, dates)
        finally:
            remove_path(spark, path)
    return _followed(attempt)


def run_batch(spark: SparkSession, raw: DataFrame, tables: Tables,
              cfg: AttendanceConfig = DEFAULT, replace_days: bool = False, report_root: str | None = None,
              run_id: str | None = None, newer_only: bool = False, load: tuple[str, int] | None = None,
              report_by: Column | None = None) -> BatchResult:
    """Load one batch of raw export rows through the three tables.

    The exports are read once: cleaned rows are staged in the shared folder.
    Rows whose key or swipe time cannot be read go to the quarantine
    (reason, the row as it came, the run id).  They become part of it by the same
    commit that brings the others into bronze, so kept and quarantined rows add
    up to the rows read, once for each load.  ``load`` (stream, batch number)
    names the load: a batch that is in already is not loaded again.

    A batch interrupted after any step can simply be run again: bronze knows its
    rows, and silver and gold take in all that bronze and silver have changed
    since.  With ``newer_only`` a copy of a swipe updates only if it was not
    received before the stored one.

    With ``report_root``, the gold rows of the batch's date range are written
    as a CSV report (minute columns as integers) to
    ``<report_root>/<run_id>/attendance_report_<first work day>``; with
    ``report_by`` one report for each of its values (such as ``source_file``), for
    the date range of that value's rows, all in one job (``write_file_reports``);
    ``report`` is their folder then.
    """
    run_id = run_id or uuid.uuid4().hex[:12]
    seen = Observation("rows")
    staged = work_path(spark, "batch")
    rows = classified(raw)
    stays = F.col("_reason").isNull()
    rows.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(stays).alias("kept"),
                 F.collect_set(F.when(stays, F.col("Date"))).alias("days")).write.parquet(staged)
    rows = spark.read.schema(rows.schema).parquet(staged)
    m = observed(seen)
    n, kept, days = int(m.get("n", 0)), int(m.get("kept", 0)), within_days(m.get("days", []))
    rejects = _write_rejects(rows, tables, run_id) if kept < n else None
    good = rows.where(F.col("_reason").isNull()).drop("_reason", "_raw")
    out = BatchResult(min(days), max(days)) if days else BatchResult(None, None)
    if days or rejects or load:
        done: UpsertResult = upsert(spark, tables.bronze, good, BRONZE_KEYS, "Date", latest="Received_On", partitions=days,
                                    newer_by="Received_On" if newer_only else None, load=load, rejects=rejects)
        out.counts["bronze"] = done.counts
        if done.repeated and rejects:
            remove_path(spark, f"{tables.rejects}/{LOAD}={rejects}")       # written again, in no version
    if days:
        out.counts["silver"] = advance_silver(spark, tables)
        out.counts["gold"] = advance_gold(spark, tables, cfg, replace_days)
    out.counts["cleaning"] = {"initial_rows": n, "final_rows": kept, "removed_rows": n - kept}
    if report_root and report_by is not None and days:
        files = good.groupBy(report_by.alias("source_file")).agg(F.min("Date").alias("first"), F.max("Date").alias("last"))
        gold = read_table(spark, tables.gold, GOLD_SCHEMA, between=(str(out.start_date), str(out.end_date)))
        write_file_reports(minutes_as_integers(gold), materialize(files), report_root, run_id)
        out.report = f"{report_root.rstrip('/')}/{run_id}"
    elif report_root and out.start_date is not None:
        report = minutes_as_integers(gold_for_range(spark, tables, out.start_date, out.end_date))
        out.report = write_report(report, report_root, run_id, first=out.start_date)
    remove_path(spark, staged)
    return out


def _write_rejects(rows: DataFrame, tables: Tables, run_id: str) -> str:
    """Rows with a reason to a folder of their own; its name."""
    name = uuid.uuid4().hex
    file = F.col("source_file") if "source_file" in rows.columns else F.lit(None).cast("string")
    rows.where(F.col("_reason").isNotNull()).select(
        file.alias("source_file"), F.col("_reason").alias("reason"), F.col("_raw").alias("row"),
        F.lit(run_id).alias("run_id")).write.parquet(f"{tables.rejects}/{LOAD}={name}")
    return name


def gold_for_range(spark: SparkSession, tables: Tables, start=None, end=None) -> DataFrame:
    """Gold rows for a work-day range, ordered by employee and day (one read).
    A range has both bounds or none."""
    if (start is None) != (end is None):
        raise ValueError("give both start and end, or neither")
    g = read_table(spark, tables.gold, GOLD_SCHEMA, between=None if start is None else (str(start), str(end)))
    if start is not None and end is not None:
        g = g.where(F.col("work_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return g.orderBy("Employee_No", "work_date")
