"""CSV round trips, names, reports and the incremental stream."""
import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SF_SMALL
from swipeflow.functions.columns import sanitize_name
from swipeflow.operators.clean import table_names
from swipeflow.sources import files as IO
from swipeflow.session import work_path


def test_csv_round_trip_keeps_quotes_blanks_and_nulls(spark):
    schema = T.StructType([T.StructField(c, T.StringType()) for c in "abcd"])
    rows = [("  a  ", "", None, 'q"uote'), ("b", "x,y", "line\nbreak", "back\\")]
    df = spark.createDataFrame(rows, schema)
    p = IO.write_csv_quoted(df, work_path(spark, "csv"), header=False)
    back = IO.read_csv(spark, p, schema, multiline=True)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)


def test_sanitizer_rule():
    assert [sanitize_name(x) for x in ["Badge #", "Site (HQ)", "__Floor__", "%", "In/Out"]] == \
        ["Badge", "Site_HQ", "Floor", "col", "In_Out"]


def test_name_collision_is_an_error():
    with pytest.raises(ValueError):
        table_names(["Door/Address", "Door Address"])


def test_report_named_by_first_day_or_today(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 5),), (dt.date(2024, 1, 3),)], "work_date date")
    root = work_path(spark, "reports")
    assert IO.write_report(df, root, "r").endswith("/r/attendance_report_2024-01-03")
    assert IO.write_report(df, root, "s", first=dt.date(2024, 1, 1)).endswith("/s/attendance_report_2024-01-01")
    assert IO.write_report(df.limit(0), root, "t").endswith(f"attendance_report_{dt.date.today():%Y-%m-%d}")


def test_stream_equals_batch(spark):
    import __spark_entry__ as E
    a = E.queries()["stream_incremental_upsert"](spark, SF_SMALL)
    b = E.queries()["upsert_gold"](spark, SF_SMALL)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_too_wide_an_export_is_an_error(spark):
    n = IO.MAX_COLUMNS
    for width in (n, n + 1):
        names = ["Employee No", *[f"c{i}" for i in range(width - 1)]]
        df = spark.range(2).select(*[F.lit("x").alias(c) for c in names])
        path = IO.write_csv_quoted(df, work_path(spark, "wide"))
        if width == n:
            assert [r[f"c{n - 2}"] for r in IO.read_landing(spark, path, extra=True).collect()] == ["x", "x"]
        else:
            with pytest.raises(Exception, match="more than"):
                IO.read_landing(spark, path, extra=True).collect()


def _shuffled_exports(spark, root):
    """Two exports of overlapping batches, the second with its columns reversed."""
    from swipeflow.sources import fixture as FX
    ev = FX.read_events(spark, SF_SMALL)
    for i in (1, 2):
        raw = FX.raw_batch(ev, i).coalesce(1)
        IO.write_csv_quoted(raw.select(*[f"`{c}`" for c in (raw.columns if i == 1 else reversed(raw.columns))]),
                            f"{root}/landing/export-{i}")


def test_newer_copies_win_however_files_are_cut(spark):
    """Both files in one micro-batch, or one by one in either order of loading:
    with ``newer_only`` and ``replace_days`` the gold table is the same."""
    from swipeflow.operators.upsert import read_table
    from swipeflow.plans.batch import Tables, run_batch
    from swipeflow.schemas import GOLD_SCHEMA
    from swipeflow.streaming.incremental import run_incremental
    got = []
    for cut in (None, 1):
        root = work_path(spark, "cut")
        t = Tables(f"{root}/b", f"{root}/s", f"{root}/g")
        _shuffled_exports(spark, root)
        run_incremental(spark, f"{root}/landing", t, f"{root}/ckpt", max_files_per_trigger=cut, newer_only=True,
                        replace_days=True)
        got.append(sorted(map(tuple, read_table(spark, t.gold, GOLD_SCHEMA).collect())))
    root = work_path(spark, "cut")
    t = Tables(f"{root}/b", f"{root}/s", f"{root}/g")
    _shuffled_exports(spark, root)
    for i in (2, 1):
        run_batch(spark, IO.read_landing(spark, f"{root}/landing/export-{i}"), t, newer_only=True, replace_days=True)
    got.append(sorted(map(tuple, read_table(spark, t.gold, GOLD_SCHEMA).collect())))
    assert got[0] == got[1] == got[2] and got[0]


def test_stream_one_file_per_micro_batch_equals_batch(spark):
    """Both exports landed first, then one availableNow run taking one file
    per micro-batch: same gold as two batch loads."""
    import __spark_entry__ as E
    from swipeflow.operators.upsert import read_table
    from swipeflow.plans.batch import Tables
    from swipeflow.schemas import GOLD_SCHEMA
    from swipeflow.sources import fixture as FX
    from swipeflow.streaming.incremental import run_incremental
    root = work_path(spark, "stream1")
    t = Tables(f"{root}/b", f"{root}/s", f"{root}/g")
    ev = FX.read_events(spark, SF_SMALL)
    for i in (1, 2):
        IO.write_csv_quoted(FX.raw_batch(ev, i).coalesce(1), f"{root}/landing/export-{i}")
    _, results = run_incremental(spark, f"{root}/landing", t, f"{root}/ckpt", max_files_per_trigger=1)
    assert len(results) == 2
    got = sorted(map(tuple, read_table(spark, t.gold, GOLD_SCHEMA).collect()))
    want = sorted(map(tuple, E.queries()["upsert_gold"](spark, SF_SMALL).collect()))
    assert got == want


def test_no_landed_row_is_lost_in_batch_and_stream(spark):
    """Headers match with blanks and in any case, files without one go to the
    quarantine, undeclared columns stay; batch and stream alike."""
    import os

    from swipeflow.operators.upsert import read_table
    from swipeflow.plans.batch import Tables, read_rejects, run_batch
    from swipeflow.streaming.incremental import run_incremental
    root = work_path(spark, "headers")
    files = {"odd": " employee no ,SWIPE DATE,Gate,Remarks\nE1,2024-06-03 08:00:00,g7,employee no\nE2,2024-06-03 09:00:00,g8,x\n,2024-06-03 09:30:00,g9,x\n",
             "none": "E3,2024-06-03 10:00:00,,a\nE4,2024-06-03 11:00:00,,b\n"}
    folder = root.removeprefix("file:") + "/landing"
    os.makedirs(folder)
    for name, text in files.items():
        with open(f"{folder}/{name}.csv", "w") as f:
            f.write(text)
    for way in ("batch", "stream"):
        t = Tables(f"{root}/{way}/b", f"{root}/{way}/s", f"{root}/{way}/g")
        if way == "batch":
            counts = run_batch(spark, IO.read_landing(spark, folder), t, run_id="one").counts
        else:
            counts = run_incremental(spark, folder, t, f"{root}/ckpt")[1][0][1].counts
        assert counts["cleaning"] == {"initial_rows": 5, "final_rows": 2, "removed_rows": 3}
        kept = read_table(spark, t.bronze).select("Employee_No", "Gate").collect()
        assert sorted(map(tuple, kept)) == [("E1", "g7"), ("E2", "g8")]
        bad = sorted((r.reason, r.row) for r in read_rejects(spark, t).collect())
        assert [b[0] for b in bad] == ["no_header", "no_header", "null_key"]
        assert bad[0][1] == '{"cells":["E3","2024-06-03 10:00:00",null,"a"]}' and '"Gate":"g9"' in bad[2][1]


def test_short_rows_are_no_malformed_rows(spark):
    """Rows with fewer cells than the widest export are read without an exception
    caught per lacking cell: the strictest mode takes them, in batch and stream."""
    from swipeflow.sources import fixture as FX
    landing = work_path(spark, "short")
    IO.write_csv_quoted(FX.raw_batch(FX.read_events(spark, SF_SMALL), 1).limit(50).coalesce(1), landing)
    want = sorted(str(r.cells) for r in IO.with_file(IO._cells(spark.read).csv(landing)).collect())
    assert len(want) == 51
    strict = IO.with_file(IO._cells(spark.read).option("mode", "FAILFAST").csv(landing))
    assert sorted(str(r.cells) for r in strict.collect()) == want
    got = []
    IO.with_file(IO._cells(spark.readStream).option("mode", "FAILFAST").csv(landing)).writeStream.foreachBatch(
        lambda b, _: got.extend(str(r.cells) for r in b.collect())).option(
        "checkpointLocation", work_path(spark, "ckpt")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(got) == want


def test_columns_are_placed_once_per_file(spark):
    """Files with other orders, lacking and further columns; places are no work per row."""
    rows = [("f1", ["Remarks", " employee NO ", "Gate"]), ("f1", ["r", "E1", "g"]), ("f1", ["s"]),
            ("f2", ["Employee No", "Swipe Date"]), ("f2", ["Employee No: none", "x"]), ("f2", [None, "y", "beyond"]), ("f3", ["E9", None])]
    out = IO.by_header(spark.createDataFrame(rows, "source_file string, cells array<string>"))
    got = sorted(((r["source_file"], r["Employee No"], r["Swipe Date"], r["Remarks"], r["Gate"], r["_no_header"]) for r in
                  out.withColumnRenamed(IO.NO_HEADER, "_no_header").collect()), key=str)
    assert got == sorted([("f1", "E1", None, "r", "g", None), ("f1", None, None, "s", None, None),
                          ("f2", "Employee No: none", "x", None, None, None), ("f2", None, "y", None, None, None),
                          ("f3", None, None, None, None, '{"cells":["E9"]}')], key=str)
    per_row = out._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]
    assert "_at_0" in per_row and "array_position" not in per_row
