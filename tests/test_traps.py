import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swipeflow.operators import clean as C
from swipeflow.operators import upsert as U
from swipeflow.session import work_path


def test_t2_float_key_loses_trailing_zero(spark):
    df = spark.createDataFrame([(1001.0,), (7.0,)], "`Employee No` double")
    assert sorted(r[0] for r in C.cast_trim(df).collect()) == ["1001", "7"]


def test_t10_unparseable_swipe_goes_to_quarantine(spark):
    schema = T.StructType([T.StructField("Employee No", T.StringType()), T.StructField("Swipe Date", T.StringType()),
                           T.StructField("In/Out", T.StringType())])
    raw = spark.createDataFrame([("1", "2024-01-10 09:00:00", "IN"), ("2", "yesterday", "IN")], schema)
    good, bad = C.clean_bronze(raw, quarantine=True)
    assert [r["Employee_No"] for r in good.collect()] == ["1"]
    assert [(r["reason"], json.loads(r["row"])) for r in bad.collect()] == [
        ("bad_swipe_date", {"Employee No": "2", "Swipe Date": "yesterday", "In/Out": "IN"})]


def test_t12_null_keys_never_inserted(spark):
    path = work_path(spark, "nullkey")
    df = spark.createDataFrame([(1, "a", "2024-01-01"), (None, "b", "2024-01-01")], "k int, v string, d string")
    r1 = U.upsert(spark, path, df, ["k"], "d")
    r2 = U.upsert(spark, path, df, ["k"], "d")
    assert r1.counts["insert"] == 1 and r2.counts["insert"] == 0
    assert U.read_table(spark, path).count() == 1


def test_t14_repeat_keys_in_one_load_keep_latest(spark):
    path = work_path(spark, "repeat")
    df = spark.createDataFrame([(1, "old", 1, "2024-01-01"), (1, "new", 2, "2024-01-01")],
                               "k int, v string, received int, d string")
    U.upsert(spark, path, df, ["k"], "d", latest="received")
    assert [r["v"] for r in U.read_table(spark, path).collect()] == ["new"]
    # loading the kept version again changes nothing
    again = spark.createDataFrame([(1, "new", 2, "2024-01-01")], "k int, v string, received int, d string")
    assert U.upsert(spark, path, again, ["k"], "d", latest="received").counts["unchanged"] == 1


def test_sanitizer_applies_to_extra_headers(spark):
    df = spark.createDataFrame([("1", "x")], "`Employee No` string, `Gate (North)#` string")
    assert C.rename_columns(df).columns == ["Employee_No", "Gate_North"]


def test_types_of_undeclared_columns_are_those_they_come_with(spark):
    df = spark.sql("SELECT '1' AS `Employee No`, 7 AS `Badge #`, 2.5D AS rate, true AS ok, '007' AS gate, 'Y' AS flag")
    out = C.typed_extras(df, ["Employee No"])
    assert dict(out.dtypes) == {"Employee_No": "string", "Badge": "bigint", "rate": "double", "ok": "boolean",
                                "gate": "string", "flag": "string"}
    assert tuple(out.first())[4:] == ("007", "Y")


def test_keys_are_read_as_written(spark):
    numbers = spark.createDataFrame([(12345678.0,), (1001.0,), (2.5,)], "`Employee No` double")
    assert [r[0] for r in C.cast_trim(numbers).collect()] == ["12345678", "1001", "2.5"]
    texts = spark.createDataFrame([("1001\t",), ("\u00a01001 ",), ("N/A",), ("nan",), (" NULL ",), ("",), (None,)],
                                  "`Employee No` string")
    assert [r[0] for r in C.cast_trim(C.drop_missing_key(texts)).collect()] == ["1001", "1001"]


def test_swipe_times_in_common_text_forms(spark):
    texts = ["2024-01-10 09:00:00", "10-Jan-2024 09:00:00", "01/10/2024 09:00", " 2024-01-10T09:00:00 ", "soon", None]
    df = spark.createDataFrame([(t,) for t in texts], "`Swipe Date` string")
    got = [r[0] for r in C.parse_swipe(df).collect()]
    assert got[:4] == [got[0]] * 4 and str(got[0]) == "2024-01-10 09:00:00" and got[4:] == [None, None]


def _files(path):
    return sorted((os.path.relpath(os.path.join(d, f), path), os.stat(os.path.join(d, f)).st_mtime_ns)
                  for d, _, fs in os.walk(path.removeprefix("file:")) for f in fs)


def test_reload_under_another_file_name_writes_nothing(spark):
    path = work_path(spark, "lineage")
    df = spark.createDataFrame([(1, "a", "2024-01-01", "f1"), (2, "b", "2024-01-02", "f1")],
                               "k int, v string, d string, source_file string")
    U.upsert(spark, path, df, ["k"], "d")
    before = _files(path)
    again = U.upsert(spark, path, df.withColumn("source_file", F.lit("f2")), ["k"], "d")
    assert again.counts["update"] == again.counts["insert"] == 0 and again.partitions_written == []
    assert _files(path) == before


def test_columns_survive_a_load_without_them(spark):
    path = work_path(spark, "columns")
    U.upsert(spark, path, spark.sql("SELECT 1 AS k, 'a' AS v, 'B' AS badge, '2024-01-01' AS d"), ["k"], "d")
    U.upsert(spark, path, spark.sql("SELECT 2 AS k, 'b' AS v, 'G' AS gate, '2024-01-01' AS d UNION ALL "
                                    "SELECT 1, 'c', 'H', '2024-01-01'"), ["k"], "d")
    got = {r.k: (r.v, r.badge, r.gate) for r in U.read_table(spark, path).collect()}
    assert got == {1: ("c", "B", "H"), 2: ("b", None, "G")}


def test_interrupted_upsert_leaves_the_table_as_it_was(spark):
    path = work_path(spark, "stopped")
    one = spark.createDataFrame([(i, "a", f"2024-01-0{1 + i % 3}") for i in range(9)], "k int, v string, d string")
    two = one.where("k < 6").withColumn("v", F.lit("b"))
    U.upsert(spark, path, one, ["k"], "d")
    assert U.upsert(spark, path, two, ["k"], "d", commit=False).counts["update"] == 6
    assert {r.k: r.v for r in U.read_table(spark, path).collect()} == {i: "a" for i in range(9)}
    U.upsert(spark, path, two, ["k"], "d")
    assert {r.k: r.v for r in U.read_table(spark, path).collect()} == {i: "b" if i < 6 else "a" for i in range(9)}


def test_too_many_partitions_are_refused(spark):
    df = spark.range(20).selectExpr("id AS k", "id AS d")
    path = work_path(spark, "many")
    U.upsert(spark, path, df, ["k"], "d")
    with pytest.raises(ValueError):
        U.upsert(spark, path, df, ["k"], "d", max_partitions=5)


def test_one_sided_range_is_refused(spark):
    from swipeflow.plans.batch import Tables, gold_for_range
    with pytest.raises(ValueError):
        gold_for_range(spark, Tables("", "", ""), start="2024-01-01")


def test_copies_of_one_swipe_are_one_before_the_slice(spark):
    from conftest import silver_rows
    from swipeflow.operators import attendance as A
    day = silver_rows(spark, [("1", "2024-01-10 09:00:00", "IN", "Card", "Approved"),
                              ("1", "2024-01-10 17:00:00", "OUT", "Card", "Approved")])
    many = day.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(100_000)))).drop("copy")
    assert A.gold_attendance(many).collect() == A.gold_attendance(day).collect()
    assert A.distinct_swipes(A.approved_swipes(many)).count() == 2
