"""Hand-computed cases (FIXTURES.md section 4): one rule per case."""
import pytest

from conftest import silver_rows
from swipeflow.operators.attendance import gold_attendance

D, D1 = "2024-01-10", "2024-01-11"
A, R = "Approved", "Rejected"
CARD, WEB = "Card Swipe", "Web Sign-In"

# emp -> (swipes, expected): status, in_time, out_time, in_dur, out_dur, span, PO, PS, OO, OS
CASES = {
    "G1": ([(f"{D} 09:00:00", "IN"), (f"{D} 18:00:00", "OUT")],
           ("Complete swipe", f"{D} 09:00:00", f"{D} 18:00:00", "09:00", "00:00", "09:00",
            "01:00", "00:00", "00:00", "00:00")),
    "G2": ([(f"{D} 09:00:00", "IN"), (f"{D} 12:00:00", "OUT"), (f"{D} 13:00:00", "IN"),
            (f"{D} 17:00:00", "OUT")],
           ("Complete swipe", f"{D} 09:00:00", f"{D} 17:00:00", "07:00", "01:00", "08:00",
            "00:00", "01:00", "00:00", "01:00")),
    "G3": ([(f"{D} 09:00:00", "IN"), (f"{D} 09:10:00", "IN"), (f"{D} 12:00:00", "OUT"),
            (f"{D} 12:05:00", "OUT")],
           ("Complete swipe", f"{D} 09:10:00", f"{D} 12:05:00", "02:55", "00:00", "02:55",
            "00:00", "05:05", "00:00", "06:05")),
    "G4": ([(f"{D} 08:00:00", "OUT"), (f"{D} 09:00:00", "IN"), (f"{D} 10:00:00", "OUT")],
           ("Incomplete swipe", "", f"{D} 10:00:00", "01:00", "00:00", "01:00",
            "00:00", "07:00", "00:00", "08:00")),
    "G5": ([(f"{D} 09:00:00", "IN"), (f"{D} 10:00:00", "OUT"), (f"{D} 11:00:00", "IN")],
           ("Incomplete swipe", f"{D} 09:00:00", "", "01:00", "01:00", "02:00",
            "00:00", "07:00", "00:00", "07:00")),
    "G6": ([(f"{D} 20:00:00", "IN"), (f"{D1} 04:59:59", "OUT")],
           ("Complete swipe", f"{D} 20:00:00", f"{D1} 04:59:59", "09:00", "00:00", "09:00",
            "01:00", "00:00", "00:00", "00:01")),
    "G10": ([(f"{D} 09:00:00", "IN"), (f"{D} 18:00:01", "OUT")],
            ("Complete swipe", f"{D} 09:00:00", f"{D} 18:00:01", "09:01", "00:00", "09:01",
             "01:01", "00:00", "00:01", "00:00")),
}
COLS = ["swipe_status", "in_time", "out_time", "in_duration", "out_duration", "full_span",
        "Productive_Overtime", "Productive_Shortfall", "Overall_Overtime", "Overall_Shortfall"]


@pytest.fixture(scope="module")
def gold(spark):
    rows = []
    for emp, (swipes, _) in CASES.items():
        rows += [(emp, w, io, CARD, A) for w, io in swipes]
    # G7: IN 20:00 on D and its OUT at 05:00:00 next day -> two incomplete days
    rows += [("G7", f"{D} 20:00:00", "IN", CARD, A), ("G7", f"{D1} 05:00:00", "OUT", CARD, A)]
    # G8: web day capped at 9 h; G9: first swipe decides (card), no cap
    rows += [("G8", f"{D} 08:00:00", "IN", WEB, A), ("G8", f"{D} 20:00:00", "OUT", WEB, A)]
    rows += [("G9", f"{D} 08:00:00", "IN", CARD, A), ("G9", f"{D} 20:00:00", "OUT", WEB, A)]
    # G11: nothing counts -> no gold row
    rows += [("G11", f"{D} 09:00:00", "IN", CARD, R), ("G11", f"{D} 10:00:00", "in", CARD, A),
             ("G11", f"{D} 11:00:00", " In ", CARD, A), ("G11", f"{D} 12:00:00", "IN", CARD, A, None)]
    g = gold_attendance(silver_rows(spark, rows)).collect()
    return {(r["Employee_No"], str(r["work_date"])): r for r in g}


@pytest.mark.parametrize("emp", list(CASES))
def test_case(gold, emp):
    row = gold[(emp, D)]
    assert tuple(row[c] for c in COLS) == CASES[emp][1]


def test_g6_minutes(gold):
    r = gold[("G6", D)]
    assert (r["in_duration_minutes"], r["out_time_minutes"], r["Overall_Shortfall_Minutes"]) == (540, 300, 0)


def test_g10_minutes(gold):
    r = gold[("G10", D)]
    assert (r["in_duration_minutes"], r["Overall_Overtime_Minutes"], r["Productive_Overtime_Minutes"]) == (540, 0, 60)


def test_g4_g5_blank_minutes(gold):
    assert gold[("G4", D)]["in_time_minutes"] == 0
    assert gold[("G5", D)]["out_time_minutes"] == 0


def test_g7_split_at_cutoff(gold):
    a, b = gold[("G7", D)], gold[("G7", D1)]
    assert (a["in_time"], a["out_time"], a["in_duration"], a["Productive_Shortfall"], a["Overall_Shortfall"]) == \
        (f"{D} 20:00:00", "", "00:00", "08:00", "09:00")
    assert (b["in_time"], b["out_time"], b["Productive_Shortfall"], b["Overall_Shortfall"]) == \
        ("", f"{D1} 05:00:00", "08:00", "09:00")


def test_g8_web_cap(gold):
    r = gold[("G8", D)]
    assert (r["sign_in_method"], r["in_duration"], r["full_span"], r["Productive_Overtime"],
            r["Overall_Overtime"]) == ("Web Sign-In", "09:00", "09:00", "01:00", "00:00")


def test_g9_first_swipe_decides(gold):
    r = gold[("G9", D)]
    assert (r["sign_in_method"], r["in_duration"], r["full_span"], r["Productive_Overtime"],
            r["Overall_Overtime"]) == ("Office Sign-In", "12:00", "12:00", "04:00", "03:00")


def test_g11_no_row(gold):
    assert not [k for k in gold if k[0] == "G11"]


def test_salt_width_does_not_matter(spark):
    """The slice width only changes the plan, never the answer, including
    islands that span slice boundaries."""
    from swipeflow.config import AttendanceConfig
    rows = []
    for emp, (swipes, _) in CASES.items():
        rows += [(emp, w, io, CARD, A) for w, io in swipes]
    s = silver_rows(spark, rows)
    base = sorted(map(tuple, gold_attendance(s).collect()))
    for width in (1, 60, 3600, 200000):
        got = sorted(map(tuple, gold_attendance(s, AttendanceConfig(salt_seconds=width)).collect()))
        assert got == base, width


def test_time_as_timestamp_or_fractional_text(spark):
    """Silver tables that keep `time` as a timestamp (or as text with a
    fraction) give the same gold as HH:mm:ss text."""
    from pyspark.sql import functions as F
    rows = [("T", f"{D} 09:00:00", "IN", CARD, A), ("T", f"{D} 18:00:00", "OUT", CARD, A)]
    base = silver_rows(spark, rows)
    want = [tuple(r) for r in gold_attendance(base).collect()]
    as_ts = base.withColumn("time", F.to_timestamp_ntz(F.concat(F.lit("1970-01-01 "), F.col("time"))))
    assert [tuple(r) for r in gold_attendance(as_ts).collect()] == want
    frac = base.withColumn("time", F.concat(F.col("time"), F.lit(".250")))
    assert [tuple(r) for r in gold_attendance(frac).collect()] == want
    bad = base.withColumn("time", F.when(F.col("In_Out") == "OUT", F.lit("late")).otherwise(F.col("time")))
    assert [(r["in_time"], r["out_time"]) for r in gold_attendance(bad).collect()] == [(f"{D} 09:00:00", "")]
