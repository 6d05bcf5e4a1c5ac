"""Trap T7 (FIXTURES.md section 5): a later file starting with a swipe before
the cut-off must rebuild the previous work day whole, not overwrite it with
the fragment."""
from conftest import raw_rows
from swipeflow.plans.batch import Tables, run_batch
from swipeflow.operators.upsert import read_table
from swipeflow.schemas import GOLD_SCHEMA
from swipeflow.session import work_path


def test_previous_day_rebuilt_whole(spark):
    root = work_path(spark, "t7")
    t = Tables(f"{root}/b", f"{root}/s", f"{root}/g")
    run_batch(spark, raw_rows(spark, [("1", "2024-01-10 09:00:00", "IN"), ("1", "2024-01-10 18:00:00", "OUT")]), t)
    run_batch(spark, raw_rows(spark, [("1", "2024-01-11 01:00:00", "OUT"), ("1", "2024-01-11 09:00:00", "IN"),
                                      ("1", "2024-01-11 17:00:00", "OUT")]), t)
    g = {str(r["work_date"]): r for r in read_table(spark, t.gold, GOLD_SCHEMA).collect()}
    d = g["2024-01-10"]
    assert (d["swipe_status"], d["in_time"], d["out_time"]) == \
        ("Complete swipe", "2024-01-10 09:00:00", "2024-01-11 01:00:00")
    d1 = g["2024-01-11"]
    assert (d1["in_time"], d1["out_time"], d1["in_duration"]) == ("2024-01-11 09:00:00", "2024-01-11 17:00:00", "08:00")


def test_reload_is_a_no_op(spark):
    root = work_path(spark, "reload")
    t = Tables(f"{root}/b", f"{root}/s", f"{root}/g")
    raw = raw_rows(spark, [("7", "2024-01-10 09:00:00", "IN"), ("7", "2024-01-10 17:00:00", "OUT")])
    run_batch(spark, raw, t)
    again = run_batch(spark, raw, t)
    for layer in ("bronze", "silver"):
        assert again.counts[layer]["insert"] == 0 and again.counts[layer]["update"] == 0
    # every day of the batch is rebuilt, and found unchanged: nothing is rewritten
    assert again.counts["gold"]["insert"] == 0 and again.counts["gold"]["update"] == 0


def _reject_day(spark, replace_days):
    root = work_path(spark, "reject")
    t = Tables(f"{root}/b", f"{root}/s", f"{root}/g")
    day = [("9", "2024-01-12 09:00:00", "IN"), ("9", "2024-01-12 17:00:00", "OUT")]
    run_batch(spark, raw_rows(spark, day), t, replace_days=replace_days)
    res = run_batch(spark, raw_rows(spark, day, status="Rejected", received_delay=60), t,
                    replace_days=replace_days)
    return res, read_table(spark, t.gold, GOLD_SCHEMA).collect()


def test_rejected_day_kept_by_default(spark):
    res, gold = _reject_day(spark, False)
    assert res.counts["silver"]["update"] == 2
    assert [r["in_time"] for r in gold] == ["2024-01-12 09:00:00"]


def test_rejected_day_removed_with_replace_days(spark):
    res, gold = _reject_day(spark, True)
    assert res.counts["gold"]["delete"] == 1
    assert gold == []


def test_rerun_after_interrupted_batch_heals_gold(spark):
    """A batch that died after silver (gold never written) is simply run again."""
    from swipeflow.operators import upsert as U
    from swipeflow.operators.clean import clean_bronze
    from swipeflow.operators.conform import silver_cast
    from swipeflow.schemas import BRONZE_KEYS, SILVER_KEYS, SILVER_SCHEMA
    root = work_path(spark, "rerun")
    t = Tables(f"{root}/b", f"{root}/s", f"{root}/g")
    raw = raw_rows(spark, [("5", "2024-01-10 09:00:00", "IN"), ("5", "2024-01-10 17:30:00", "OUT"),
                           ("5", "2024-01-11 02:00:00", "IN"), ("5", "2024-01-11 03:00:00", "OUT")])
    U.upsert(spark, t.bronze, clean_bronze(raw), BRONZE_KEYS, "Date", latest="Received_On")
    U.upsert(spark, t.silver, silver_cast(read_table(spark, t.bronze)), SILVER_KEYS, "Date",
             schema=SILVER_SCHEMA, unique_keys=True)
    res = run_batch(spark, raw, t)
    assert res.counts["bronze"]["insert"] == 0 and res.counts["silver"]["insert"] == 0
    assert res.counts["gold"]["insert"] == 1
    g = read_table(spark, t.gold, GOLD_SCHEMA).collect()
    assert [(str(r["work_date"]), r["in_time"], r["out_time"]) for r in g] == \
        [("2024-01-10", "2024-01-10 09:00:00", "2024-01-11 03:00:00")]


def test_batch_reports_removed_rows(spark):
    from pyspark.sql import functions as F
    root = work_path(spark, "removed")
    t = Tables(f"{root}/b", f"{root}/s", f"{root}/g")
    raw = raw_rows(spark, [("1", "2024-01-10 09:00:00", "IN"), ("--", "2024-01-10 10:00:00", "IN"),
                           ("2", "2024-01-10 11:00:00", "OUT")])
    raw = raw.withColumn("Employee No", F.when(F.col("`Employee No`") == "2", None)
                         .otherwise(F.col("`Employee No`")))
    res = run_batch(spark, raw, t)
    assert res.counts["cleaning"] == {"initial_rows": 3, "final_rows": 1, "removed_rows": 2}


def test_batch_writes_report_for_its_range(spark):
    from swipeflow.sources.files import NO_NULLS, read_csv
    root = work_path(spark, "report")
    t = Tables(f"{root}/b", f"{root}/s", f"{root}/g")
    raw = raw_rows(spark, [("3", "2024-01-15 09:00:00", "IN"), ("3", "2024-01-15 17:00:00", "OUT")])
    res = run_batch(spark, raw, t, report_root=f"{root}/reports", run_id="r1")
    assert res.report.endswith("/r1/attendance_report_2024-01-15")
    rows = read_csv(spark, res.report, header=True, null_value=NO_NULLS).collect()
    assert [(r["Employee_No"], r["in_duration"], r["in_duration_minutes"]) for r in rows] == [("3", "08:00", "480")]
