"""Swipe exports derived from the ``events`` table (FIXTURES.md section 2).

Nothing is synthesized: every swipe is one event row, so the work of each
query grows with the table.  ``dense`` folds users onto 20 employees (long
days, many islands); ``sparse`` keeps one employee per user (many small days).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import plus_seconds, time_text, whole_seconds
from ..schemas import RAW_SCHEMA, SILVER_SCHEMA

# --- fixed values: fixture rules ---
DENSE_EMPLOYEES = 20
HOT_EVERY = 3            # 'hot': users with user_id % 3 = 0 share badge '0'
IO_BY_EVENT = {"view": "In", "signup": "IN", "click": "Out", "purchase": "OUT", "error": "Out"}
REJECTED_EVENT = "error"
WEB_EVERY = 3            # event_id % 3 = 0 -> web sign-in
RECEIVED_LAG_MOD = 7     # Received_On = Swipe_Date + (event_id % 7) minutes
DIRTY_EVERY = 50         # dirty rows: event_id % 50 in (0, 1, 2, 3, 5, 6, 7)
DUPLICATE_EVERY = 10     # re-sent rows: event_id % 10 = 0, a day later, Remarks 'v2'
# --- end of fixed values ---


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _employee(density: str) -> Column:
    """``dense``: 20 employees; ``sparse``: one per user; ``hot``: one per
    user, except that every third user swipes with the same shared badge
    ``0`` (one key holding a third of all rows)."""
    uid = F.col("user_id")
    if density == "dense":
        return (uid % DENSE_EMPLOYEES).cast("string")
    if density == "sparse":
        return uid.cast("string")
    if density == "hot":
        return F.when(uid % HOT_EVERY == 0, F.lit("0")).otherwise(uid.cast("string"))
    raise ValueError(f"density must be 'dense', 'sparse' or 'hot', not {density!r}")


def _io() -> Column:
    e = F.col("event_type")
    out = None
    for k, v in IO_BY_EVENT.items():
        out = (F.when(e == k, v) if out is None else out.when(e == k, v))
    return out


def _base(events: DataFrame, density: str) -> DataFrame:
    emp = _employee(density)
    swipe = whole_seconds(F.col("ts"))
    return events.select(
        F.col("event_id"),
        emp.alias("emp"),
        swipe.alias("swipe"),
        _io().alias("io_raw"),
        F.when(F.col("event_type") == REJECTED_EVENT, "Rejected").otherwise("Approved").alias("status"),
        F.when(F.col("event_id") % WEB_EVERY == 0, "Web Sign-In").otherwise("Card Swipe").alias("stype"),
        F.col("value"),
        F.col("props"),
    ).withColumn(
        "received", plus_seconds(F.col("swipe"), (F.col("event_id") % RECEIVED_LAG_MOD) * 60)
    )


def raw_swipes(events: DataFrame, density: str = "sparse", dirty: bool = False,
               duplicates: bool = False, keep_event_id: bool = False,
               swipe_as_text: bool = False) -> DataFrame:
    """Rows shaped like a raw swipe export (the 18 header names).

    ``dirty`` adds the cleaning cases (NULL / missing-value text / punctuation-only
    / padded keys, a padded direction); ``duplicates`` re-sends every tenth swipe a day
    later; ``swipe_as_text`` gives ``Swipe Date`` as text with some
    unparseable values, as a CSV export would.
    """
    b = _base(events, density)
    emp = F.col("emp")
    io = F.col("io_raw")
    if dirty:
        k = F.col("event_id") % DIRTY_EVERY
        emp = (F.when(k == 0, F.lit(None).cast("string"))
               .when(k == 1, F.lit("--"))
               .when(k == 2, F.concat(F.lit("  "), emp, F.lit("  ")))
               .when(k == 5, F.lit("N/A"))
               .when(k == 6, F.concat(emp, F.lit("\t")))
               .when(k == 7, F.concat(F.lit("\u00a0"), emp))
               .otherwise(emp))
        io = F.when(k == 3, F.lit(" In ")).otherwise(io)
    null_s = F.lit(None).cast("string")
    cols = {
        "Employee No": emp,
        "Employee Name": F.concat(F.lit("Employee "), F.col("emp")),
        "Access Card": F.concat(F.lit("AC-"), F.col("emp")),
        "Shift": null_s,
        "Swipe Date": F.col("swipe"),
        "Door/Address": null_s,
        "In/Out": io,
        "Longitude": F.col("value"),
        "Latitude": -F.col("value"),
        "Location Type": null_s,
        "Mobile Device Name": null_s,
        "Mobile Device Id": null_s,
        "Swipe Type": F.col("stype"),
        "Status": F.col("status"),
        "Remarks": F.col("props"),
        "Permission Reason": null_s,
        "Signed In/Out By": null_s,
        "Received On": F.col("received"),
    }
    types = {f.name: f.dataType for f in RAW_SCHEMA.fields}
    if swipe_as_text:
        k, at = F.col("event_id") % DIRTY_EVERY, F.col("swipe")
        cols["Swipe Date"] = (F.when(k == 4, F.lit("not a date"))
                              .when(k == 8, F.date_format(at, "dd-MMM-yyyy HH:mm:ss"))
                              .when(k == 9, F.date_format(at, "MM/dd/yyyy HH:mm"))
                              .otherwise(at.cast("string")))
        types["Swipe Date"] = None  # already text
    sel = [(cols[n] if types[n] is None else cols[n].cast(types[n])).alias(n) for n in RAW_SCHEMA.fieldNames()]
    if keep_event_id:
        sel.append(F.col("event_id"))
    out = b.select(*sel)
    if duplicates:
        redo = b.where(F.col("event_id") % DUPLICATE_EVERY == 0)
        cols2 = dict(cols)
        cols2["Received On"] = plus_seconds(F.col("received"), F.lit(86400))
        cols2["Remarks"] = F.lit("v2")
        sel2 = [(cols2[n] if types[n] is None else cols2[n].cast(types[n])).alias(n)
                for n in RAW_SCHEMA.fieldNames()]
        if keep_event_id:
            sel2.append(F.col("event_id"))
        out = out.unionByName(redo.select(*sel2))
    return out


def silver_swipes(events: DataFrame, density: str = "dense") -> DataFrame:
    """Rows shaped like the silver table (24 columns), straight from events.

    This is what the gold computation reads.  No de-duplication is applied
    (the gold query does not de-duplicate either), so same-second swipes of
    one employee stay, which exercises the tie-breakers.
    """
    b = _base(events, density)
    sw = F.col("swipe")
    null_s = F.lit(None).cast("string")
    cols = {
        "Employee_No": F.col("emp"),
        "Employee_Name": F.concat(F.lit("Employee "), F.col("emp")),
        "Access_Card": F.concat(F.lit("AC-"), F.col("emp")),
        "Shift": null_s,
        "Swipe_Date": sw.cast("string"),
        "Year": F.year(sw),
        "Day": F.dayofmonth(sw),
        "Month_short_name": F.date_format(F.to_date(sw), "MMM"),
        "Month_Number": F.month(sw),
        "Date": F.to_date(sw),
        "time": time_text(sw),
        "Door_Address": null_s,
        "In_Out": F.col("io_raw"),
        "Longitude": F.col("value"),
        "Latitude": -F.col("value"),
        "Location_Type": null_s,
        "Mobile_Device_Name": null_s,
        "Mobile_Device_Id": null_s,
        "Swipe_Type": F.col("stype"),
        "Status": F.col("status"),
        "Remarks": F.col("props"),
        "Permission_Reason": null_s,
        "Signed_In_Out_By": null_s,
        "Received_On": F.col("received"),
    }
    return b.select(*[cols[f.name].cast(f.dataType).alias(f.name) for f in SILVER_SCHEMA.fields])


# --- fixed values: two overlapping re-exports for the upsert scenarios ---
BATCH1_BEFORE = "2024-01-20"  # batch 1: swipes before this day
BATCH2_FROM = "2024-01-10"    # batch 2: swipes from this day on
EDIT_EVERY = 4                # in the overlap, event_id % 4 = 0 comes back edited
REJECT_EVERY = 8              # ... and event_id % 8 = 0 comes back Rejected
# --- end of fixed values ---


def raw_batch(events: DataFrame, n: int, density: str = "sparse") -> DataFrame:
    """Batch 1 or 2 of a re-export: batch 2 overlaps batch 1 by ten days and
    re-sends some overlapping swipes edited (``Remarks`` 'v2', received an
    hour later) or rejected."""
    ts = F.col("ts")
    if n == 1:
        ev = events.where(ts < F.lit(BATCH1_BEFORE).cast("timestamp_ntz"))
    elif n == 2:
        ev = events.where(ts >= F.lit(BATCH2_FROM).cast("timestamp_ntz"))
    else:
        raise ValueError("batch is 1 or 2")
    raw = raw_swipes(ev, density, keep_event_id=True)
    if n == 2:
        overlap = F.col("`Swipe Date`") < F.lit(BATCH1_BEFORE).cast("timestamp_ntz")
        eid = F.col("event_id")
        edit = overlap & (eid % EDIT_EVERY == 0)
        raw = raw.withColumns({
            "Remarks": F.when(edit, F.lit("v2")).otherwise(F.col("Remarks")),
            "Received On": F.when(edit, plus_seconds(F.col("`Received On`"), F.lit(3600)))
                            .otherwise(F.col("`Received On`")),
            "Status": F.when(overlap & (eid % REJECT_EVERY == 0), F.lit("Rejected"))
                       .otherwise(F.col("Status")),
        })
    return raw.drop("event_id")
