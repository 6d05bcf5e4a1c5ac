"""Properties: invariants of gold and of the upsert, on the events fixture."""
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from swipeflow.operators import attendance as A
from swipeflow.operators import islands as I
from swipeflow.operators import upsert as U
from swipeflow.sources import fixture as FX
from swipeflow.session import work_path


def _silver(spark, sf=SF_SMALL, density="dense"):
    return FX.silver_swipes(FX.read_events(spark, sf), density)


def test_input_order_does_not_change_gold(spark):
    s = _silver(spark)
    a = sorted(map(tuple, A.gold_attendance(s).collect()))
    shuffled = s.repartition(7, F.rand(11)).orderBy(F.rand(5))
    b = sorted(map(tuple, A.gold_attendance(shuffled).collect()))
    assert a == b


def test_overtime_and_shortfall_exclusive(spark):
    g = A.gold_attendance(_silver(spark))
    bad = g.where(((F.col("Productive_Overtime_Minutes") > 0) & (F.col("Productive_Shortfall_Minutes") > 0))
                  | ((F.col("Overall_Overtime_Minutes") > 0) & (F.col("Overall_Shortfall_Minutes") > 0)))
    assert bad.count() == 0


def test_inside_plus_outside_within_span_on_complete_days(spark):
    d = A.day_measures(A.approved_swipes(_silver(spark)))
    complete = d.where((F.col("first_io") == "IN") & (F.col("last_io") == "OUT"))
    assert complete.where(F.col("in_seconds") + F.col("out_seconds") > F.col("raw_full_span_seconds")).count() == 0
    assert complete.where(F.col("in_seconds") + F.col("out_seconds") != F.col("raw_full_span_seconds")).count() == 0


def test_salted_equals_joined_form(spark):
    sw = A.approved_swipes(_silver(spark, SF_SMALL, "sparse"))
    a = sorted(map(tuple, A.day_measures(sw).select(*A.DAY, "in_seconds", "out_seconds",
                                                     "raw_full_span_seconds").collect()))
    b = sorted(map(tuple, I.day_measures_joined(sw).select(*A.DAY, "in_seconds", "out_seconds",
                                                            "raw_full_span_seconds").collect()))
    assert a == b


def test_rownum_and_lag_islands_agree(spark):
    sw = A.approved_swipes(_silver(spark))
    lag = I.islands_lag(sw).groupBy(*A.DAY).agg(F.countDistinct("grp").alias("n"))
    rn = I.islands_rownum(sw).groupBy(*A.DAY).agg(F.countDistinct("io", "grp").alias("n"))
    assert sorted(map(tuple, lag.collect())) == sorted(map(tuple, rn.collect()))


def _upsert_sides(spark):
    """FIXTURES.md section 3 (sf0.01): key event_id, partition = day of ts."""
    ev = FX.read_events(spark, SF_MID).select("event_id", "ts", "value")
    ev = ev.withColumn("day", F.to_date("ts"))
    tgt = ev.where(F.col("event_id") % 3 != 0)
    src = ev.where(F.col("event_id") % 2 == 0).withColumn(
        "value", F.when(F.col("event_id") % 4 == 0, F.col("value") + 1).otherwise(F.col("value")))
    return tgt, src


def test_upsert_fixture_counts_and_idempotence(spark):
    tgt, src = _upsert_sides(spark)
    path = work_path(spark, "upsert-fixture")
    U.upsert(spark, path, tgt, ["event_id"], "day", unique_keys=True)
    r1 = U.upsert(spark, path, src, ["event_id"], "day", unique_keys=True)
    assert r1.counts == {"insert": 1667, "update": 1666, "unchanged": 1667, "target_only": 3333, "delete": 0}
    assert sum(r1.counts.values()) == 8333
    r2 = U.upsert(spark, path, src, ["event_id"], "day", unique_keys=True)
    assert r2.counts == {"insert": 0, "update": 0, "unchanged": 5000, "target_only": 3333, "delete": 0}
    assert r2.partitions_written == []
    assert U.read_table(spark, path).count() == 8333


def test_dedup_keeps_latest(spark):
    raw = FX.raw_swipes(FX.read_events(spark, SF_SMALL), "sparse", duplicates=True)
    from swipeflow.operators import clean as C, conform as S
    silver = S.dedup_latest(S.silver_cast(C.clean_bronze(raw)))
    # every re-sent key keeps its 'v2' copy
    keys = raw.where(F.col("Remarks") == "v2").select(
        F.col("`Employee No`").alias("Employee_No"), F.col("`Swipe Date`").cast("string").alias("Swipe_Date"))
    kept = silver.join(keys, ["Employee_No", "Swipe_Date"])
    assert kept.count() == keys.count() > 0
    assert kept.where(F.col("Remarks") != "v2").count() == 0


def test_hot_badge_days_are_cut_into_slices(spark):
    """Badge '0' holds a third of all swipes; each of its days must reach the
    ordered step as many slice groups, not as one group."""
    sw = A.approved_swipes(_silver(spark, SF_MID, "hot"))
    assert sw.where(F.col("Employee_No") == "0").count() * 4 > sw.count()  # about a third
    per_day = A.slice_summaries(sw).where(F.col("Employee_No") == "0").groupBy("work_date").count()
    assert per_day.agg(F.min("count")).first()[0] >= 10
