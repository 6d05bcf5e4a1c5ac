"""Gaps-and-islands stages, one operator per stage of the textbook plan.

The textbook plan runs every step as a window over a whole employee-day.
Here the ordered steps run inside time slices of that day (the salt) and
are stitched with a per-slice summary, so no step holds a whole busy day in
one task:

* ``islands_lag``: island starts from the previous swipe; the island number
  ``grp`` is a running count of starts.  Inside a slice both come from
  windows; the first row of a slice takes its previous swipe from the
  summary of the slice before, and the running count gets the slice's offset.
* ``grp`` is then the dense island ordinal of the day, so the collapsed
  sequence number *is* ``grp`` and the next/previous island is an equi-join
  on ``grp + 1`` (unique keys, nothing hot), not a day-wide window.
* Per-day facts (first/last direction, first swipe type) are aggregates.

``day_islands`` is the short way where no column per swipe is asked for: equal
swipes are one, runs of one direction become one row inside their slice, and a
window over these few rows joins runs across slices.  No row is joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, AttendanceConfig
from ..functions.columns import plus_seconds
from ..session import materialize_by
from .attendance import DAY, DAY_ORDER, TIE_BREAK, distinct_swipes

SLICE = "slice"


def _order():
    return [F.col("sec")] + [F.col(c).asc_nulls_first() for c in TIE_BREAK]


def with_slice(swipes: DataFrame, cfg: AttendanceConfig = DEFAULT) -> DataFrame:
    return swipes.withColumn(SLICE, F.floor(F.col("sec") / F.lit(cfg.salt_seconds)))


def _slice_windows():
    w = Window.partitionBy(*DAY, SLICE).orderBy(*_order())
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    across = Window.partitionBy(*DAY).orderBy(SLICE)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    return w, run, across, before


def islands_lag(swipes: DataFrame, cfg: AttendanceConfig = DEFAULT) -> DataFrame:
    """Each swipe with ``prev_io``, ``is_start`` and island number ``grp``."""
    w, run, across, before = _slice_windows()
    rows = with_slice(swipes, cfg)
    rows = rows.withColumn("_rn", F.row_number().over(w)).withColumn("_lag", F.lag("io").over(w))
    local_start = F.col("_lag").isNull() | (F.col("_lag") != F.col("io"))
    rows = rows.withColumn("_start", local_start.cast("long"))
    rows = rows.withColumn("_run", F.sum("_start").over(run))
    summ = rows.groupBy(*DAY, SLICE).agg(
        F.max(F.when(F.col("_rn") == 1, F.col("io"))).alias("_first_io"),
        F.max_by("io", F.col("_rn")).alias("_last_io"),
        F.sum("_start").alias("_n"),
    )
    summ = summ.withColumn("_prev_last", F.lag("_last_io").over(across))
    first_start = (F.col("_prev_last").isNull() | (F.col("_prev_last") != F.col("_first_io"))).cast("long")
    summ = summ.withColumn("_fs", first_start)
    summ = summ.withColumn("_off", F.coalesce(F.sum(F.col("_n") - 1 + F.col("_fs")).over(before), F.lit(0)))
    out = rows.join(summ.select(*DAY, SLICE, "_prev_last", "_fs", "_off"), [*DAY, SLICE])
    first = F.col("_rn") == 1
    return out.select(
        *[c for c in swipes.columns], SLICE,
        F.when(first, F.col("_prev_last")).otherwise(F.col("_lag")).alias("prev_io"),
        F.when(first, F.col("_fs") == 1).otherwise(F.col("_start") == 1).alias("is_start"),
        (F.col("_off") + F.col("_run") - (F.lit(1) - F.col("_fs"))).alias("grp"),
    )


def islands_rownum(swipes: DataFrame, cfg: AttendanceConfig = DEFAULT) -> DataFrame:
    """Row-number form: ``rn_all`` over the day, ``rn_io`` within the
    direction, ``grp = rn_all - rn_io``.  Both numbers are running counts,
    taken per slice plus the counts of the slices before."""
    w, run, across, before = _slice_windows()
    rows = with_slice(swipes, cfg)
    is_in = (F.col("io") == "IN").cast("long")
    rows = rows.withColumn("_in", is_in)
    rows = rows.withColumn("_all_run", F.row_number().over(w)) \
               .withColumn("_in_run", F.sum("_in").over(run))
    summ = rows.groupBy(*DAY, SLICE).agg(F.count(F.lit(1)).alias("_n"), F.sum("_in").alias("_nin"))
    summ = summ.select(
        *DAY, SLICE,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off_all"),
        F.coalesce(F.sum("_nin").over(before), F.lit(0)).alias("_off_in"),
    )
    out = rows.join(summ, [*DAY, SLICE])
    rn_all = F.col("_off_all") + F.col("_all_run")
    rn_in = F.col("_off_in") + F.col("_in_run")
    rn_io = F.when(F.col("io") == "IN", rn_in).otherwise(rn_all - rn_in)
    return out.select(*swipes.columns, rn_all.cast("long").alias("rn_all"),
                      rn_io.cast("long").alias("rn_io"), (rn_all - rn_io).cast("long").alias("grp"))


def collapse(islands: DataFrame) -> DataFrame:
    """One row per island, at its last swipe; ``seq`` is the island ordinal."""
    return islands.groupBy(*DAY, "io", "grp").agg(
        F.max("Employee_Name").alias("Employee_Name"),
        F.max("swipe_ts").alias("effective_ts"),
        F.max("sec").alias("effective_sec"),
    ).withColumn("seq", F.col("grp"))


def first_last_value(collapsed: DataFrame) -> DataFrame:
    """Each island with the day's first and last direction."""
    ends = collapsed.groupBy(*DAY).agg(
        F.min_by("io", F.col("seq")).alias("first_io_temp"),
        F.max_by("io", F.col("seq")).alias("last_io_temp"),
    )
    return collapsed.join(ends, DAY)


def pairs(collapsed: DataFrame) -> DataFrame:
    """Each island with the next island's end and direction, and the previous
    direction.  Directions alternate by construction, so the previous
    direction is the other one whenever ``seq > 1``."""
    nxt = collapsed.select(*DAY, (F.col("seq") - 1).alias("seq"),
                           F.col("effective_ts").alias("end_ts"), F.col("effective_sec").alias("end_sec"),
                           F.col("io").alias("end_io"))
    p = collapsed.join(nxt, [*DAY, "seq"], "left")
    other = F.when(F.col("io") == "IN", "OUT").otherwise("IN")
    return p.withColumn("prev_io", F.when(F.col("seq") > 1, other))


def in_intervals(p: DataFrame) -> DataFrame:
    d = F.col("end_sec") - F.col("effective_sec")
    return p.where((F.col("io") == "IN") & (F.col("end_io") == "OUT") & (d > 0)) \
        .select(*DAY, "seq", d.alias("dur_seconds"))


def out_intervals(p: DataFrame) -> DataFrame:
    d = F.col("end_sec") - F.col("effective_sec")
    return p.where((F.col("io") == "OUT") & (F.col("end_io") == "IN") & (F.col("prev_io") == "IN") & (d > 0)) \
        .select(*DAY, "seq", d.alias("dur_seconds"))


def sum_seconds(intervals: DataFrame, name: str) -> DataFrame:
    return intervals.groupBy(*DAY).agg(F.sum("dur_seconds").cast("long").alias(name))


def day_first_last(collapsed: DataFrame) -> DataFrame:
    return collapsed.groupBy(*DAY).agg(
        F.max("Employee_Name").alias("Employee_Name"),
        F.min_by("io", F.col("seq")).alias("first_io"),
        F.max_by("io", F.col("seq")).alias("last_io"),
        F.min(F.when(F.col("io") == "IN", F.col("effective_ts"))).alias("min_in_ts"),
        F.max(F.when(F.col("io") == "OUT", F.col("effective_ts"))).alias("max_out_ts"),
        F.min(F.when(F.col("io") == "IN", F.col("effective_sec"))).alias("min_in_sec"),
        F.max(F.when(F.col("io") == "OUT", F.col("effective_sec"))).alias("max_out_sec"),
    )


def slice_runs(swipes: DataFrame, cfg: AttendanceConfig = DEFAULT) -> DataFrame:
    """Runs of one direction inside a time slice: one row each, with its last
    second and the type of its first swipe.  One scan; the aggregate keeps the
    partitioning of the windows."""
    rows = with_slice(distinct_swipes(swipes), cfg)
    w = Window.partitionBy(*DAY, SLICE).orderBy(F.col("sec"), *[F.col(c).asc_nulls_first() for c in DAY_ORDER])
    rows = rows.withColumn("_lag", F.lag("io").over(w))
    start = F.col("_lag").isNull() | (F.col("_lag") != F.col("io"))
    rows = rows.withColumn("run", F.sum(start.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy(*DAY, SLICE, "run").agg(
        F.max("io").alias("io"), F.max("Employee_Name").alias("Employee_Name"), F.max("sec").alias("effective_sec"),
        F.min_by("Swipe_Type", F.struct("sec", *DAY_ORDER)).alias("first_type"))


def day_islands(swipes: DataFrame, cfg: AttendanceConfig = DEFAULT) -> DataFrame:
    """Collapsed islands with their ordinal ``seq``, the next island's end and
    the previous direction.  The day-wide windows see runs, not swipes: at most
    one per distinct second and direction, whatever was sent how often."""
    across = Window.partitionBy(*DAY).orderBy(SLICE, "run")
    runs = slice_runs(swipes, cfg).withColumn("_lag", F.lag("io").over(across))
    start = F.col("_lag").isNull() | (F.col("_lag") != F.col("io"))
    runs = runs.withColumn("seq", F.sum(start.cast("long")).over(across.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    islands = runs.groupBy(*DAY, "seq").agg(
        F.max("io").alias("io"), F.max("Employee_Name").alias("Employee_Name"), F.max("effective_sec").alias("effective_sec"),
        F.min_by("first_type", F.struct(SLICE, "run")).alias("first_type"))
    w = Window.partitionBy(*DAY).orderBy("seq")
    return islands.select(
        "*", plus_seconds(F.to_timestamp_ntz(F.col("work_date")), F.col("effective_sec")).alias("effective_ts"),
        F.lead("effective_sec").over(w).alias("end_sec"), F.lead("io").over(w).alias("end_io"),
        F.lag("io").over(w).alias("prev_io"))


def first_swipe(swipes: DataFrame) -> DataFrame:
    """Swipe type of the day's first swipe, as an aggregate (``min_by``)."""
    key = F.struct(F.col("sec"), *[F.col(c) for c in TIE_BREAK])
    return swipes.groupBy(*DAY).agg(F.min_by("Swipe_Type", key).alias("first_swipe_type"))


def day_measures_joined(swipes: DataFrame, cfg: AttendanceConfig = DEFAULT) -> DataFrame:
    """Day measures assembled like the textbook plan: first/last, inside
    and outside sums and first swipe type, left-joined on (employee, day).
    Every joined side has one row per day, so the joins have no hot key; all
    sides come from one bucketing by day, so neither sums nor joins exchange rows."""
    # the islands feed four branches: computed once and stored in buckets of the
    # day, a partitioning that every branch and every join keeps
    p = materialize_by(day_islands(swipes, cfg), *DAY)
    f = day_first_last(p)
    a = sum_seconds(in_intervals(p), "in_seconds")
    o = sum_seconds(out_intervals(p), "out_seconds")
    fs = p.where("seq = 1").select(*DAY, F.col("first_type").alias("first_swipe_type"))
    j = f.join(a, DAY, "left").join(o, DAY, "left").join(fs, DAY, "left")
    ins = F.coalesce("in_seconds", F.lit(0))
    outs = F.coalesce("out_seconds", F.lit(0))
    complete = (F.col("first_io") != "OUT") & (F.col("last_io") != "IN")
    span = F.when(complete, F.col("max_out_sec") - F.col("min_in_sec")).otherwise(ins + outs)
    return j.select(
        *DAY, "Employee_Name", "first_io", "last_io", "min_in_ts", "max_out_ts", "first_swipe_type",
        ins.cast("long").alias("in_seconds"), outs.cast("long").alias("out_seconds"),
        span.cast("long").alias("raw_full_span_seconds"),
    ).where(F.col("min_in_ts").isNotNull() | F.col("max_out_ts").isNotNull())
