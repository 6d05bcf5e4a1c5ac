"""The salted day measures against a plain-Python statement of the rules,
on random swipe sequences (seeded): islands collapse to their last swipe,
IN->OUT gaps are inside time, OUT->IN gaps after an IN are outside time."""
import datetime as dt
import random

import pytest

from conftest import silver_rows
from swipeflow.config import AttendanceConfig
from swipeflow.operators import attendance as A

BASE = dt.datetime(2024, 1, 10, 0, 0, 0)


def _sequences(seed=7, employees=150):
    rnd = random.Random(seed)
    rows = []
    for e in range(employees):
        t = BASE + dt.timedelta(seconds=rnd.randrange(0, 20 * 3600))
        for _ in range(rnd.randrange(1, 30)):
            # mostly minutes apart, sometimes the same second, sometimes hours
            step = rnd.choice([0, 0, 1, 30, 60, 600, 3600, 4 * 3600, 9 * 3600])
            t += dt.timedelta(seconds=step)
            io = rnd.choice(["IN", "OUT", "In", "Out"])
            stype = rnd.choice(["Card Swipe", "Web Sign-In"])
            rows.append((f"E{e}", t.strftime("%Y-%m-%d %H:%M:%S"), io, stype, "Approved"))
    return rows


def _brute(rows):
    days = {}
    for i, (emp, when, io, stype, _) in enumerate(rows):
        ts = dt.datetime.strptime(when, "%Y-%m-%d %H:%M:%S")
        wd = (ts - dt.timedelta(days=1)).date() if ts.hour < 5 else ts.date()
        # same tie order as the engine: time, direction, type, swipe text, received, longitude
        days.setdefault((emp, wd), []).append(((ts, io.upper(), stype, when, ts, float(i)), io.upper(), stype))
    out = {}
    for key, sw in days.items():
        sw.sort(key=lambda x: x[0])
        islands = []
        for k, io, _ in sw:
            if islands and islands[-1][0] == io:
                islands[-1] = (io, k[0])
            else:
                islands.append((io, k[0]))
        ins = outs = 0
        for j in range(len(islands) - 1):
            (io, a), (nio, b) = islands[j], islands[j + 1]
            d = int((b - a).total_seconds())
            if io == "IN" and nio == "OUT" and d > 0:
                ins += d
            if io == "OUT" and nio == "IN" and j > 0 and islands[j - 1][0] == "IN" and d > 0:
                outs += d
        first_io, last_io = islands[0][0], islands[-1][0]
        min_in = min((t for io, t in islands if io == "IN"), default=None)
        max_out = max((t for io, t in islands if io == "OUT"), default=None)
        complete = first_io != "OUT" and last_io != "IN"
        span = int((max_out - min_in).total_seconds()) if complete else ins + outs
        out[key] = (first_io, last_io, min_in, max_out, sw[0][2], ins, outs, span)
    return out


@pytest.fixture(scope="module")
def case(spark):
    rows = _sequences()
    return silver_rows(spark, rows), _brute(rows)


@pytest.mark.parametrize("width", [1, 7, 900, 86400 * 3])
def test_salted_measures_match_brute_force(case, width):
    silver, expected = case
    assert len(expected) > 150 and sum(v[6] > 0 for v in expected.values()) > 20
    d = A.day_measures(A.approved_swipes(silver), AttendanceConfig(salt_seconds=width))
    got = {(r["Employee_No"], r["work_date"]): (r["first_io"], r["last_io"], r["min_in_ts"], r["max_out_ts"],
                                                r["first_swipe_type"], r["in_seconds"], r["out_seconds"],
                                                r["raw_full_span_seconds"]) for r in d.collect()}
    assert got == expected


@pytest.mark.parametrize("width", [1, 7, 900])
def test_salted_textbook_stages_match_brute_force(case, width):
    from swipeflow.operators import islands as I
    silver, expected = case
    d = I.day_measures_joined(A.approved_swipes(silver), AttendanceConfig(salt_seconds=width))
    got = {(r["Employee_No"], r["work_date"]): (r["first_io"], r["last_io"], r["min_in_ts"], r["max_out_ts"],
                                                r["first_swipe_type"], r["in_seconds"], r["out_seconds"],
                                                r["raw_full_span_seconds"]) for r in d.collect()}
    assert got == expected
