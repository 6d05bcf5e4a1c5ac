"""Tables by versions: writers at once, readers at any time, deltas, the feed, the ledger."""
import glob
import os
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from conftest import raw_rows
from pyspark.sql import functions as F

from swipeflow.operators import upsert as U
from swipeflow.operators import versions as V
from swipeflow.plans import batch as B
from swipeflow.session import work_path
from swipeflow.sources import files as IO

KIND = "k int, v string, d string"


def rows(spark, values):
    return spark.createDataFrame([(k, v, f"2024-01-0{1 + k % 3}") for k, v in values.items()], KIND)


def held(spark, path, **how):
    got = U.read_table(spark, path, **how).collect()
    assert len({r.k for r in got}) == len(got)
    return {r.k: r.v for r in got}


def load(spark, path, values, **how):
    return U.upsert(spark, path, rows(spark, values), ["k"], "d", **how)


def size(path):
    return sum(os.path.getsize(f) for f in glob.glob(path.removeprefix("file:") + "/**/*.parquet", recursive=True))


def test_all_versions_can_be_read(spark):
    path, now, seen = work_path(spark, "many"), {}, []
    r = random.Random(3)
    for n in range(5):
        values = {r.randrange(40): f"{n}-{r.randrange(3)}" for _ in range(9)}
        res = load(spark, path, values)
        assert res.counts["insert"] == len(values.keys() - now.keys())
        assert res.counts["update"] == sum(now.get(k, v) != v for k, v in values.items())
        now |= values
        seen.append((res.version, dict(now)))
        assert held(spark, path) == now
    assert [held(spark, path, version=v) for v, _ in seen] == [x for _, x in seen]
    assert held(spark, path, partitions=["2024-01-02"]) == {k: v for k, v in now.items() if k % 3 == 1}
    assert held(spark, path, between=("2024-01-02", "2024-01-03")) == {k: v for k, v in now.items() if k % 3}
    before = V.current(spark, path)
    assert U.compact(spark, path) == 3 and held(spark, path) == now
    assert all(len(x) == 1 for x in V.current(spark, path).parts.values()) and held(spark, path, version=before.number) == now
    load(spark, path, {1: "after", 100: "new"})
    assert held(spark, path) == now | {1: "after", 100: "new"}


def test_a_writer_that_is_overtaken(spark, monkeypatch):
    """Another load commits between the reading and the commit of this one:
    in other days the rows stand, in the same days they are computed again."""
    path = work_path(spark, "overtaken")
    load(spark, path, dict.fromkeys(range(9), "a"))
    write, calls = U._write, []

    def between(frame, where, name, *rest):
        write(frame, where, name, *rest)
        calls.append(name)
        if len(calls) == 1:
            load(spark, path, other)
    monkeypatch.setattr(U, "_write", between)
    other = {1: "other", 4: "other"}                     # day 2
    res = load(spark, path, {0: "mine", 3: "mine"})      # day 1
    assert len(calls) == 2 and res.counts["update"] == 2
    calls.clear()
    other = {0: "late", 12: "late"}                      # the same day: this load comes last and is compared with it
    res = load(spark, path, {0: "late", 3: "last", 12: "x"})
    assert len(calls) == 3 and res.counts == {"insert": 0, "update": 2, "unchanged": 1, "target_only": 1, "delete": 0}
    want = dict.fromkeys(range(9), "a") | {1: "other", 4: "other", 0: "late", 3: "last", 12: "x"}
    assert held(spark, path) == want
    assert not [n for n in V.names(spark, path) if n.startswith("_load=") and n[6:] not in {
        x for p in V.current(spark, path).parts.values() for x, _ in p}]


def test_writers_at_once(spark):
    path = work_path(spark, "crowd")
    loads = [{k: f"w{n}" for k in range(n, n + 6)} for n in range(0, 24, 6)]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda x: load(spark, path, x), loads))
    want = {k: v for x in loads for k, v in x.items()}
    assert held(spark, path) == want and V.current(spark, path).number == 4


def test_a_number_is_taken_once(spark):
    path = work_path(spark, "once")
    v = V.commit(spark, path, V.Version(), loads={"a": 1})
    with pytest.raises(V.Conflict):
        V.commit(spark, path, V.Version(), loads={"b": 1})
    assert V.current(spark, path) == v and v.loads == {"a": 1}
    assert not [n for n in V.names(spark, f"{path}/_versions") if n.endswith(".tmp")]


def test_a_reader_sees_whole_versions(spark, monkeypatch):
    """Read before and after every step of a load, of compaction and of vacuum."""
    path, old, new = work_path(spark, "reader"), dict.fromkeys(range(9), "a"), dict.fromkeys(range(3, 12), "b")
    load(spark, path, old)
    seen, real = [], {n: getattr(U, n) for n in ("_write", "remove_path")} | {"commit": V.commit}

    def watched(name):
        def step(*args, **kw):
            seen.append(held(spark, path))
            out = real[name](*args, **kw)
            seen.append(held(spark, path))
            return out
        return step
    for name in real:
        monkeypatch.setattr(V if name == "commit" else U, name, watched(name))
    load(spark, path, new)
    assert len(seen) >= 4 and all(s in (old, old | new) for s in seen) and seen[0] == old and seen[-1] == old | new
    snapshot = U.read_table(spark, path)
    U.compact(spark, path)
    V.vacuum(spark, path, keep=5, older_than_s=0)
    assert {r.k: r.v for r in snapshot.collect()} == old | new and held(spark, path) == old | new


def test_vacuum_keeps_what_versions_name(spark):
    path = work_path(spark, "vacuum")
    for n in range(4):
        load(spark, path, {k: str(n) for k in range(6)})
    load(spark, path, {0: "lost"}, commit=False)                       # an interrupted load's rows
    U.compact(spark, path)
    assert V.vacuum(spark, path, keep=1) == []                         # all too young
    want, before = {k: "3" for k in range(6)}, size(path)
    gone = V.vacuum(spark, path, keep=1, older_than_s=0)
    assert len([g for g in gone if g.startswith("_versions")]) == 4 and size(path) < before / 3
    assert held(spark, path) == want
    with pytest.raises(LookupError):
        U.change_feed(spark, path, after=0)


def test_written_bytes_follow_the_changes(spark):
    """One late swipe in a day of many writes one row, not the day."""
    path, n = work_path(spark, "delta"), 60_000
    day = spark.range(n).selectExpr("cast(id AS int) AS k", "sha2(cast(id AS string), 256) AS v", "'2024-01-01' AS d")
    U.upsert(spark, path, day, ["k"], "d")
    whole = size(path)
    U.upsert(spark, path, day.where("k = 7").withColumn("v", F.lit("late")), ["k"], "d")
    one = size(path) - whole
    U.upsert(spark, path, day.where("k % 10 = 0").withColumn("v", F.concat("v", F.lit("x"))), ["k"], "d")
    tenth = size(path) - whole - one
    assert one < whole / 200 and one * 10 < tenth < whole / 2
    got = U.read_table(spark, path).where("v = 'late' OR v LIKE '%x'").count()
    assert got == 1 + n // 10 and U.read_table(spark, path).count() == n


def test_rows_of_one_key_skip_row_groups(spark):
    """Files are sorted by key, so most row groups need not be read for one."""
    import pyarrow.parquet as pq
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("parquet.block.size", str(64 * 1024))
    conf.set("parquet.page.size.row.check.min", "50")
    try:
        path = work_path(spark, "clustered")
        day = spark.range(60_000).selectExpr("cast(pmod(hash(id), 1000) AS string) AS e", "id AS k",
                                             "sha2(cast(id AS string), 256) AS v", "'2024-01-01' AS d")
        U.upsert(spark, path, day, ["e", "k"], "d")
    finally:
        conf.unset("parquet.block.size")
        conf.unset("parquet.page.size.row.check.min")
    sizes, read = 0, 0
    for f in glob.glob(path.removeprefix("file:") + "/**/*.parquet", recursive=True):
        meta = pq.ParquetFile(f).metadata
        at = meta.schema.names.index("e")
        for g in range(meta.num_row_groups):
            stats = meta.row_group(g).column(at).statistics
            sizes += meta.row_group(g).total_byte_size
            read += meta.row_group(g).total_byte_size * (stats.min <= "77" <= stats.max)
    assert 0 < read < sizes / 5
    assert U.read_table(spark, path).where("e = '77'").count() == day.where("e = '77'").count()


def test_crowded_partitions_are_compacted(spark, monkeypatch):
    monkeypatch.setattr(U, "MAX_FOLDERS", 2)
    path = work_path(spark, "crowded")
    for n in range(4):
        load(spark, path, {k: str(n) for k in range(4)})
    assert all(len(x) <= 2 for x in V.current(spark, path).parts.values()) and held(spark, path) == dict.fromkeys(range(4), "3")
    feed = U.change_feed(spark, path).select("_action", "k", "v", "_old.v").collect()
    assert sorted(map(tuple, feed)) == sorted(
        [("insert", k, "0", None) for k in range(4)] + [("update", k, str(n), str(n - 1)) for n in (1, 2, 3) for k in range(4)])


def test_deleted_rows_stay_deleted_and_come_back(spark):
    path, kind = work_path(spark, "deleted"), "e int, k int, v string, d string"
    one = spark.createDataFrame([(1, 1, "a", "x"), (1, 2, "a", "x"), (2, 3, "a", "x")], kind)
    U.upsert(spark, path, one, ["e", "k"], "d")
    scope = spark.createDataFrame([(1, "x")], "e int, d string")
    res = U.upsert(spark, path, one.where("k = 1"), ["e", "k"], "d", scope=scope.select("e"))
    assert res.counts["delete"] == 1 and held(spark, path) == {1: "a", 3: "a"}
    assert [tuple(r) for r in U.change_feed(spark, path, after=1).select("_action", "k", "_old.v").collect()] == [("delete", 2, "a")]
    assert U.upsert(spark, path, one.where("k = 2"), ["e", "k"], "d").counts["insert"] == 1
    assert held(spark, path) == {1: "a", 2: "a", 3: "a"}
    U.compact(spark, path)
    assert held(spark, path) == {1: "a", 2: "a", 3: "a"}


def test_a_plain_table_is_taken_over(spark):
    path = work_path(spark, "plain")
    rows(spark, dict.fromkeys(range(6), "a")).write.partitionBy("d").parquet(path)
    assert held(spark, path) == dict.fromkeys(range(6), "a")
    assert load(spark, path, {0: "b", 9: "c"}).counts["update"] == 1
    assert held(spark, path) == dict.fromkeys(range(6), "a") | {0: "b", 9: "c"}


def test_a_load_is_in_once(spark):
    path = work_path(spark, "ledger")
    assert not load(spark, path, {1: "a"}, load=("s", 0)).repeated
    assert load(spark, path, {1: "z"}, load=("s", 0)).repeated
    assert not load(spark, path, {1: "b"}, load=("t", 0)).repeated
    assert not load(spark, path, {1: "b"}, load=("s", 1)).repeated      # changes nothing, but is in
    assert load(spark, path, {1: "z"}, load=("s", 1)).repeated
    assert held(spark, path) == {1: "b"} and V.current(spark, path).loads == {"s": 1, "t": 0}


DAY = [("1", "2024-01-10 09:00:00", "IN"), ("1", "2024-01-10 18:00:00", "OUT"), ("2", "2024-01-10 09:00:00", "IN"),
       ("2", "2024-01-11 02:00:00", "OUT")]


def tables(spark, name):
    root = work_path(spark, name)
    return B.Tables(f"{root}/b", f"{root}/s", f"{root}/g")


def test_known_rows_window_no_swipe(spark, monkeypatch):
    t = tables(spark, "known")
    B.run_batch(spark, raw_rows(spark, DAY), t)
    at = [V.current(spark, p).number for p in (t.bronze, t.silver, t.gold)]
    monkeypatch.setattr(B, "gold_attendance", None)
    monkeypatch.setattr(B, "silver_cast", None)
    again = B.run_batch(spark, raw_rows(spark, DAY), t)
    assert [V.current(spark, p).number for p in (t.bronze, t.silver, t.gold)] == at
    assert again.counts["bronze"]["unchanged"] == 4


def test_gold_follows_only_what_changed(spark, monkeypatch):
    t, asked, real = tables(spark, "changed"), [], B.gold_attendance
    B.run_batch(spark, raw_rows(spark, DAY), t)

    def gold(silver, cfg, only):
        asked.append(sorted((r[0], str(r[1])) for r in only.collect()))
        return real(silver, cfg, only=only)
    monkeypatch.setattr(B, "gold_attendance", gold)
    B.run_batch(spark, raw_rows(spark, [*DAY, ("2", "2024-01-11 04:59:00", "OUT")], received_delay=0), t)
    assert asked == [[("2", "2024-01-10")]]
    got = {r.Employee_No: r.out_time for r in U.read_table(spark, t.gold).collect()}
    assert got == {"1": "2024-01-10 18:00:00", "2": "2024-01-11 04:59:00"}


@pytest.mark.parametrize("step", ["bronze", "silver"])
def test_a_stopped_batch_is_taken_up_by_the_next(spark, monkeypatch, step):
    """A load that died after bronze or silver; another load, of other rows, brings its days too."""
    t = tables(spark, "stopped")
    with monkeypatch.context() as m:
        m.setattr(B, "advance_silver" if step == "bronze" else "advance_gold", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            B.run_batch(spark, raw_rows(spark, DAY), t)
    B.run_batch(spark, raw_rows(spark, [("3", "2024-01-12 09:00:00", "IN"), ("3", "2024-01-12 17:00:00", "OUT")]), t)
    got = sorted((r.Employee_No, str(r.work_date), r.out_time) for r in U.read_table(spark, t.gold).collect())
    assert got == [("1", "2024-01-10", "2024-01-10 18:00:00"), ("2", "2024-01-10", "2024-01-11 02:00:00"),
                   ("3", "2024-01-12", "2024-01-12 17:00:00")]


def test_two_streams_and_a_repeated_batch(spark):
    """Bad rows of both streams stay, each once; batches of only bad rows count too."""
    from swipeflow.streaming.incremental import run_incremental, take_batch
    root = work_path(spark, "streams")
    t = B.Tables(f"{root}/b", f"{root}/s", f"{root}/g")
    local = root.removeprefix("file:")
    head = "Employee No,Swipe Date,In/Out,Swipe Type,Status\n"
    files = {"a": head + "E1,2024-06-03 08:00:00,IN,Card,Approved\n,2024-06-03 09:00:00,IN,Card,Approved\n",
             "b": head + "E2,soon,IN,Card,Approved\n--,2024-06-03 09:30:00,IN,Card,Approved\n"}
    ids = {}
    for name, text in files.items():
        os.makedirs(f"{local}/in-{name}")
        with open(f"{local}/in-{name}/1.csv", "w") as f:
            f.write(text)
        ids[name] = run_incremental(spark, f"{local}/in-{name}", t, f"{root}/ckpt-{name}")[0].id
    for name in files:
        again = IO.with_file(IO._cells(spark.read).csv(f"{local}/in-{name}"))
        counts = take_batch(again, ids[name], 0, t).counts
        assert not any(counts["bronze"].values())
    assert sorted((r.reason, r.run_id) for r in B.read_rejects(spark, t).collect()) == sorted(
        [("null_key", f"{ids['a']}-0"), ("bad_swipe_date", f"{ids['b']}-0"), ("no_word_key", f"{ids['b']}-0")])
    assert [r.Employee_No for r in U.read_table(spark, t.bronze).collect()] == ["E1"]
    assert V.current(spark, t.bronze).loads == {ids["a"]: 0, ids["b"]: 0}


# ---- pages, appended files, reports
def test_pages(spark):
    from swipeflow.operators.paging import build_page_index, count_rows, read_page
    df = spark.range(1000).selectExpr("cast(pmod(id * 617, 1000) AS int) AS k", "id AS v").repartition(7)
    path = build_page_index(df, ["k"], work_path(spark, "pages"))
    want = sorted(map(tuple, df.collect()))
    assert count_rows(spark, path) == 1000
    for offset, limit in ((0, 10), (990, 50), (240, 300), (5, 0), (1000, 5), (0, 1000), (499, 1)):
        page = read_page(spark, path, offset, limit, df.schema)
        assert [tuple(r) for r in page.collect()] == want[offset:offset + limit]
    page = read_page(spark, path, 700, 5, df.schema)
    assert len({f.rsplit("/", 2)[1] for f in page.inputFiles()}) <= 2
    plan = page._jdf.queryExecution().toString()
    assert "TakeOrdered" not in plan and "Limit" not in plan
    empty = build_page_index(df.limit(0), ["k"], work_path(spark, "pages"))
    assert count_rows(spark, empty) == 0 and read_page(spark, empty, 0, 5, df.schema).count() == 0


def test_cells_that_do_not_read_are_kept_and_files_load_once(spark):
    root, table = work_path(spark, "csv").removeprefix("file:"), work_path(spark, "appended")
    os.makedirs(root)

    def put(name, text):
        with open(f"{root}/{name}.csv", "w") as f:
            f.write(text)
    put("1", "id,n\na,1\nb,two\nc,\\N\n")
    types = {"n": "bigint"}
    IO.load_csv_append(spark, root, table, types, force=False)
    IO.load_csv_append(spark, root, table, types, force=False)
    put("2", "id,n\nd,4\n")
    IO.load_csv_append(spark, root, table, types, force=False)
    got = sorted((r.id, r.n, r[IO.RESCUED]) for r in IO.read_merged(spark, table).collect())
    assert got == [("a", 1, None), ("b", None, '{"n":"two"}'), ("c", None, None), ("d", 4, None)]
    IO.load_csv_append(spark, root, table, types)                         # forced: appended again
    assert IO.read_merged(spark, table).count() == 8
