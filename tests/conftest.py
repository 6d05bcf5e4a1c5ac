import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from swipeflow.schemas import RAW_SCHEMA, SILVER_SCHEMA  # noqa: E402
from swipeflow.session import local_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, shuffle_partitions=4, app="swipeflow-tests")
    yield s


def ts(text: str) -> dt.datetime:
    return dt.datetime.strptime(text, "%Y-%m-%d %H:%M:%S")


def silver_rows(spark, rows):
    """rows: (emp, 'YYYY-MM-DD HH:MM:SS', In_Out, Swipe_Type, Status[, time_override])."""
    out = []
    for i, r in enumerate(rows):
        emp, when, io, stype, status = r[:5]
        t = ts(when)
        time_txt = r[5] if len(r) > 5 else t.strftime("%H:%M:%S")
        rec = dict.fromkeys(SILVER_SCHEMA.fieldNames())
        rec.update(Employee_No=emp, Employee_Name=f"Employee {emp}", Swipe_Date=when, Date=t.date(),
                   time=time_txt, In_Out=io, Swipe_Type=stype, Status=status,
                   Received_On=t, Longitude=float(i), Year=t.year, Day=t.day, Month_Number=t.month,
                   Month_short_name=t.strftime("%b"))
        out.append(tuple(rec[c] for c in SILVER_SCHEMA.fieldNames()))
    return spark.createDataFrame(out, SILVER_SCHEMA)


def raw_rows(spark, rows, status="Approved", received_delay=0):
    """rows: (emp, 'YYYY-MM-DD HH:MM:SS', In/Out) -> raw export rows, card swipes."""
    out = []
    for emp, when, io in rows:
        rec = dict.fromkeys(RAW_SCHEMA.fieldNames())
        rec.update({"Employee No": emp, "Employee Name": f"Employee {emp}", "Swipe Date": ts(when),
                    "In/Out": io, "Swipe Type": "Card Swipe", "Status": status,
                    "Received On": ts(when) + dt.timedelta(seconds=received_delay)})
        out.append(tuple(rec[c] for c in RAW_SCHEMA.fieldNames()))
    return spark.createDataFrame(out, RAW_SCHEMA)
