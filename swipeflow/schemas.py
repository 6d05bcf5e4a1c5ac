"""Declared schemas of the raw export and the three medallion tables."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: raw export headers and their table column names ---
RENAME_MAP = {
    "Employee No": "Employee_No",
    "Employee Name": "Employee_Name",
    "Access Card": "Access_Card",
    "Shift": "Shift",
    "Swipe Date": "Swipe_Date",
    "Door/Address": "Door_Address",
    "In/Out": "In_Out",
    "Longitude": "Longitude",
    "Latitude": "Latitude",
    "Location Type": "Location_Type",
    "Mobile Device Name": "Mobile_Device_Name",
    "Mobile Device Id": "Mobile_Device_Id",
    "Swipe Type": "Swipe_Type",
    "Status": "Status",
    "Remarks": "Remarks",
    "Permission Reason": "Permission_Reason",
    "Signed In/Out By": "Signed_In_Out_By",
    "Received On": "Received_On",
}
# --- end of fixed values ---

RAW_COLUMNS = list(RENAME_MAP)
NO_HEADER = "_no_header"      # cells, as JSON, of landed rows whose file has no header

_S, _D, _TS = T.StringType(), T.DoubleType(), T.TimestampNTZType()

RAW_SCHEMA = T.StructType(
    [
        T.StructField(name, _TS if name in ("Swipe Date", "Received On") else
                      _D if name in ("Longitude", "Latitude") else _S)
        for name in RAW_COLUMNS
    ]
)

# Bronze: the 18 renamed columns plus six parts derived from Swipe_Date.
BRONZE_SCHEMA = T.StructType(
    [T.StructField(RENAME_MAP[f.name], f.dataType) for f in RAW_SCHEMA.fields]
    + [
        T.StructField("Date", T.DateType()),
        T.StructField("time", _S),
        T.StructField("Year", T.IntegerType()),
        T.StructField("Day", T.IntegerType()),
        T.StructField("Month_short_name", _S),
        T.StructField("Month_Number", T.IntegerType()),
    ]
)

# --- fixed values: names, order and types of the silver and gold columns ---
# `time` stays an HH:mm:ss string: casting
# a bare time of day to TIMESTAMP stamps it with the run date, which would
# make every re-run look like a change.
SILVER_SCHEMA = T.StructType(
    [
        T.StructField("Employee_No", _S),
        T.StructField("Employee_Name", _S),
        T.StructField("Access_Card", _S),
        T.StructField("Shift", _S),
        T.StructField("Swipe_Date", _S),
        T.StructField("Year", T.IntegerType()),
        T.StructField("Day", T.IntegerType()),
        T.StructField("Month_short_name", _S),
        T.StructField("Month_Number", T.IntegerType()),
        T.StructField("Date", T.DateType()),
        T.StructField("time", _S),
        T.StructField("Door_Address", _S),
        T.StructField("In_Out", _S),
        T.StructField("Longitude", _D),
        T.StructField("Latitude", _D),
        T.StructField("Location_Type", _S),
        T.StructField("Mobile_Device_Name", _S),
        T.StructField("Mobile_Device_Id", _S),
        T.StructField("Swipe_Type", _S),
        T.StructField("Status", _S),
        T.StructField("Remarks", _S),
        T.StructField("Permission_Reason", _S),
        T.StructField("Signed_In_Out_By", _S),
        T.StructField("Received_On", _TS),
    ]
)
SILVER_KEYS = ["Employee_No", "Swipe_Date"]

GOLD_CLOCK_COLUMNS = [
    "in_duration", "out_duration", "full_span",
    "Productive_Overtime", "Productive_Shortfall", "Overall_Overtime", "Overall_Shortfall",
]
GOLD_MINUTE_COLUMNS = [
    "in_time_minutes", "out_time_minutes", "in_duration_minutes", "out_duration_minutes",
    "Productive_Overtime_Minutes", "Productive_Shortfall_Minutes",
    "Overall_Overtime_Minutes", "Overall_Shortfall_Minutes",
]
GOLD_SCHEMA = T.StructType(
    [
        T.StructField("Employee_No", _S),
        T.StructField("Employee_Name", _S),
        T.StructField("work_date", T.DateType()),
        T.StructField("sign_in_method", _S),
        T.StructField("swipe_status", _S),
        T.StructField("in_time", _S),
        T.StructField("out_time", _S),
    ]
    + [T.StructField(c, _S) for c in GOLD_CLOCK_COLUMNS]
    + [T.StructField(c, _D) for c in GOLD_MINUTE_COLUMNS]
)
GOLD_KEYS = ["Employee_No", "work_date"]

BRONZE_KEYS = ["Employee_No", "Swipe_Date"]
# --- end of fixed values ---


def ddl(schema: T.StructType) -> str:
    """`a STRING, b DOUBLE` text for readers that take a DDL schema."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString().upper()}" for f in schema.fields)
