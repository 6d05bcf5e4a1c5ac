"""Silver swipes -> one gold row per employee per work day.

How the day measures are computed
---------------------------------
Consecutive swipes with the same direction form an *island*; an island
counts at its last swipe (its *end*).  With island ends e1 <= e2 <= ... <= en
(directions alternate), time inside is the sum of IN->OUT gaps and time
outside the sum of OUT->IN gaps that follow an IN.  Those sums telescope
into plain aggregates over island ends:

    inside  = sum(OUT ends) - [first island is OUT] * first OUT end
              - (sum(IN ends) - [last island is IN] * last IN swipe)
    outside = sum(IN ends) - first IN end
              - (sum(OUT ends) - [first island is OUT] * first OUT end
                 - [last island is OUT and n > 1] * last OUT swipe)

So the only order-dependent fact needed per swipe is "is the next swipe of
this employee-day in the other direction (or absent)?"  That flag is taken
with ``lead`` inside time slices of ``salt_seconds`` (the salt), and the
last swipe of each slice is settled from a one-row-per-slice summary.  All
other work is sum/min/max, which Spark pre-aggregates before each shuffle.

Plan: one exchange of swipe rows on (employee, work day, slice), one
exchange of slice summaries on (employee, work day), no join.  A busy
employee-day is spread over up to ``86400 / salt_seconds + 1`` tasks; the
summary window holds at most that many rows per day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as cfg_labels
from ..config import DEFAULT, AttendanceConfig
from ..functions.columns import (
    hhmm, normalize_io, over, plus_seconds, round_minutes,
    second_of_work_day, swipe_timestamp, time_text, under, web_capped, work_date,
)

# Total order of swipes inside one employee-day: time, then direction, then
# columns that make equal-second swipes deterministic (IN sorts before OUT).
# Row-level outputs (island numbers per swipe) use all of it.
TIE_BREAK = ["io", "Swipe_Type", "Swipe_Date", "Received_On", "Longitude"]
# Day-level outputs need only (time, direction, type): swipes equal on those
# are interchangeable for every gold column (either can be the island end at
# the same second, and the first swipe has the same direction and type), so
# the flagship orders by them alone and the other columns never enter the
# shuffle.
DAY_ORDER = ["io", "Swipe_Type"]
DAY = ["Employee_No", "work_date"]


def approved_swipes(silver: DataFrame, cfg: AttendanceConfig = DEFAULT,
                    start=None, end=None) -> DataFrame:
    """Approved swipes with a time and a valid direction, with work day and
    ``sec`` (whole seconds since midnight of the work day).

    ``start``/``end`` bound the calendar ``Date`` (this prunes partitions of a
    silver table partitioned by ``Date``).
    """
    cond = (F.col("Status") == cfg.approved_status) & F.col("time").isNotNull()
    if cfg.normalize_io_first:
        cond = cond & normalize_io(F.col("In_Out")).isin(sorted({v.upper() for v in cfg.accepted_io}))
    else:
        cond = cond & F.col("In_Out").isin(list(cfg.accepted_io))
    if start is not None:
        cond = cond & (F.col("Date") >= F.lit(start).cast("date"))
    if end is not None:
        cond = cond & (F.col("Date") <= F.lit(end).cast("date"))
    time_col = F.col("time")
    if isinstance(silver.schema["time"].dataType, (T.TimestampType, T.TimestampNTZType)):
        # silver tables that keep `time` as a timestamp: only its clock time counts
        time_col = time_text(time_col.cast("timestamp_ntz"))
    ts = swipe_timestamp(F.col("Date").cast("date"), time_col)
    cond = cond & ts.isNotNull()
    s = silver.where(cond).select(
        "Employee_No", "Employee_Name",
        ts.alias("swipe_ts"),
        normalize_io(F.col("In_Out")).alias("io"),
        "Swipe_Type", "Swipe_Date", "Received_On", "Longitude",
    )
    s = s.withColumn("work_date", work_date(F.col("swipe_ts"), cfg))
    return s.withColumn("sec", second_of_work_day(F.col("swipe_ts"), F.col("work_date")))


def _order():
    return [F.col("sec")] + [F.col(c).asc_nulls_first() for c in DAY_ORDER]


def distinct_swipes(swipes: DataFrame) -> DataFrame:
    """One row per employee, work day, second, direction and type: equal swipes
    say nothing more about a day.  Reduced map-side, so a time slice holds at
    most one row per second and kind whatever was sent how often."""
    return swipes.groupBy(*DAY, "sec", "io", "Swipe_Type").agg(F.max("Employee_Name").alias("Employee_Name"))


def slice_summaries(swipes: DataFrame, cfg: AttendanceConfig = DEFAULT) -> DataFrame:
    """One row per (employee, work day, time slice) with island-end sums.

    Island ends inside a slice are known from ``lead``; the slice's last
    swipe is settled later by ``day_measures``.
    """
    s = distinct_swipes(swipes).withColumn("slice", F.floor(F.col("sec") / F.lit(cfg.salt_seconds)))
    w = Window.partitionBy(*DAY, "slice").orderBy(*_order())
    s = s.withColumn("nxt", F.lead("io").over(w)).withColumn("rn", F.row_number().over(w))
    end = F.col("nxt").isNotNull() & (F.col("nxt") != F.col("io"))
    is_in, is_out = F.col("io") == "IN", F.col("io") == "OUT"
    sec = F.col("sec")
    return s.groupBy(*DAY, "slice").agg(
        F.max("Employee_Name").alias("name"),
        F.max(F.when(F.col("rn") == 1, F.col("io"))).alias("first_io"),
        F.max(F.when(F.col("rn") == 1, F.col("Swipe_Type"))).alias("first_type"),
        F.max(F.when(F.col("nxt").isNull(), F.col("io"))).alias("last_io"),
        F.max(sec).alias("last_sec"),
        F.sum(F.when(end & is_in, sec)).alias("s_in"),
        F.sum(F.when(end & is_out, sec)).alias("s_out"),
        F.count(F.when(end, 1)).alias("n_end"),
        F.min(F.when(end & is_in, sec)).alias("fe_in"),
        F.min(F.when(end & is_out, sec)).alias("fe_out"),
        F.max(F.when(is_in, sec)).alias("le_in"),
        F.max(F.when(is_out, sec)).alias("le_out"),
    )


def day_measures(swipes: DataFrame, cfg: AttendanceConfig = DEFAULT) -> DataFrame:
    """Per (employee, work day): first/last direction, first IN island end,
    last OUT swipe, first swipe type, seconds inside/outside and raw span."""
    sl = slice_summaries(swipes, cfg)
    w = Window.partitionBy(*DAY).orderBy("slice")
    sl = sl.withColumn("next_first_io", F.lead("first_io").over(w))
    # the slice's last swipe ends an island unless the next slice starts
    # with the same direction
    last_end = F.col("next_first_io").isNull() | (F.col("next_first_io") != F.col("last_io"))
    add_in = F.when(last_end & (F.col("last_io") == "IN"), F.col("last_sec"))
    add_out = F.when(last_end & (F.col("last_io") == "OUT"), F.col("last_sec"))
    sl = sl.select(
        *DAY, "slice", "name", "first_io", "first_type", "last_io", "le_in", "le_out",
        (F.coalesce("s_in", F.lit(0)) + F.coalesce(add_in, F.lit(0))).alias("s_in"),
        (F.coalesce("s_out", F.lit(0)) + F.coalesce(add_out, F.lit(0))).alias("s_out"),
        (F.col("n_end") + last_end.cast("long")).alias("n_end"),
        F.least("fe_in", add_in).alias("fe_in"),
        F.least("fe_out", add_out).alias("fe_out"),
    )
    d = sl.groupBy(*DAY).agg(
        F.max("name").alias("Employee_Name"),
        F.min_by(F.struct("first_io", "first_type"), F.col("slice")).alias("first"),
        F.max_by("last_io", F.col("slice")).alias("last_io"),
        F.sum("s_in").alias("s_in"),
        F.sum("s_out").alias("s_out"),
        F.sum("n_end").alias("n_end"),
        F.min("fe_in").alias("fe_in"),
        F.min("fe_out").alias("fe_out"),
        F.max("le_in").alias("le_in"),
        F.max("le_out").alias("le_out"),
    )
    first_io, last_io = F.col("first.first_io"), F.col("last_io")
    lead_out = F.when(first_io == "OUT", F.col("fe_out")).otherwise(F.lit(0))
    trail_in = F.when(last_io == "IN", F.col("le_in")).otherwise(F.lit(0))
    trail_out = F.when((last_io == "OUT") & (F.col("n_end") > 1), F.col("le_out")).otherwise(F.lit(0))
    inside = (F.col("s_out") - lead_out) - (F.col("s_in") - trail_in)
    outside = (F.col("s_in") - F.coalesce("fe_in", F.lit(0))) - (F.col("s_out") - lead_out - trail_out)
    day0 = F.to_timestamp_ntz(F.col("work_date"))
    complete = (first_io != "OUT") & (last_io != "IN")
    d = d.select(
        "Employee_No", "Employee_Name", "work_date",
        first_io.alias("first_io"), last_io.alias("last_io"),
        plus_seconds(day0, F.col("fe_in")).alias("min_in_ts"),
        plus_seconds(day0, F.col("le_out")).alias("max_out_ts"),
        F.col("first.first_type").alias("first_swipe_type"),
        inside.cast("long").alias("in_seconds"),
        outside.cast("long").alias("out_seconds"),
        F.when(complete, F.col("le_out") - F.col("fe_in"))
        .otherwise(inside + outside).cast("long").alias("raw_full_span_seconds"),
    )
    return d.where(F.col("min_in_ts").isNotNull() | F.col("max_out_ts").isNotNull())


def gold_columns(day: DataFrame, cfg: AttendanceConfig = DEFAULT) -> DataFrame:
    """Day measures -> the 22 gold columns (clock text and minute numbers)."""
    ftype = F.col("first_swipe_type")
    first_io, last_io = F.col("first_io"), F.col("last_io")
    in_cap = web_capped(F.col("in_seconds"), ftype, cfg)
    span_cap = web_capped(F.col("raw_full_span_seconds"), ftype, cfg)
    out_s = F.col("out_seconds")
    p_ot, p_sf = over(in_cap, cfg.productive_seconds), under(in_cap, cfg.productive_seconds)
    o_ot, o_sf = over(span_cap, cfg.overall_seconds), under(span_cap, cfg.overall_seconds)
    tod = lambda ts: round_minutes(F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts))
    dbl = lambda c: c.cast("double")
    return day.select(
        "Employee_No", "Employee_Name", "work_date",
        F.when(ftype.like(cfg.web_pattern), cfg_labels.WEB_LABEL).otherwise(cfg_labels.OFFICE_LABEL).alias("sign_in_method"),
        F.when((first_io != "OUT") & (last_io != "IN"), cfg_labels.COMPLETE_LABEL)
        .otherwise(cfg_labels.INCOMPLETE_LABEL).alias("swipe_status"),
        F.when(first_io == "OUT", "").otherwise(F.col("min_in_ts").cast("string")).alias("in_time"),
        F.when(last_io == "IN", "").otherwise(F.col("max_out_ts").cast("string")).alias("out_time"),
        hhmm(in_cap).alias("in_duration"),
        hhmm(out_s).alias("out_duration"),
        hhmm(span_cap).alias("full_span"),
        hhmm(p_ot).alias("Productive_Overtime"),
        hhmm(p_sf).alias("Productive_Shortfall"),
        hhmm(o_ot).alias("Overall_Overtime"),
        hhmm(o_sf).alias("Overall_Shortfall"),
        dbl(F.when(first_io == "OUT", 0).otherwise(tod(F.col("min_in_ts")))).alias("in_time_minutes"),
        dbl(F.when(last_io == "IN", 0).otherwise(tod(F.col("max_out_ts")))).alias("out_time_minutes"),
        dbl(round_minutes(in_cap)).alias("in_duration_minutes"),
        dbl(round_minutes(out_s)).alias("out_duration_minutes"),
        dbl(round_minutes(p_ot)).alias("Productive_Overtime_Minutes"),
        dbl(round_minutes(p_sf)).alias("Productive_Shortfall_Minutes"),
        dbl(round_minutes(o_ot)).alias("Overall_Overtime_Minutes"),
        dbl(round_minutes(o_sf)).alias("Overall_Shortfall_Minutes"),
    )


def minutes_as_integers(gold: DataFrame) -> DataFrame:
    """The eight minute columns as integers for a report; anything that is
    not a number reads as 0."""
    from ..schemas import GOLD_MINUTE_COLUMNS
    return gold.withColumns({c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).cast("long")
                             for c in GOLD_MINUTE_COLUMNS})


def gold_attendance(silver: DataFrame, cfg: AttendanceConfig = DEFAULT,
                    start=None, end=None, only: DataFrame | None = None) -> DataFrame:
    """The flagship: silver swipes -> 22-column gold rows.  ``only`` (employee,
    work day) keeps the swipes of those days before anything is windowed."""
    swipes = approved_swipes(silver, cfg, start, end)
    if only is not None:
        swipes = swipes.join(only, DAY, "left_semi")
    return gold_columns(day_measures(swipes, cfg), cfg)


__all__ = [
    "approved_swipes", "slice_summaries", "day_measures", "gold_columns", "gold_attendance",
    "minutes_as_integers",
    "TIE_BREAK", "DAY_ORDER", "DAY",
]
