"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import attendance as A
from ..sources import fixture as FX
from . import oracle as O

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def silver_fixture(spark: SparkSession, sf_dir: str, density: str = "dense") -> DataFrame:
    return FX.silver_swipes(FX.read_events(spark, sf_dir), density)


@register("gold_attendance", O.gold_sql("dense"))
def gold_attendance(spark, sf_dir):
    """Flagship: silver swipes (dense employees) -> gold rows."""
    return A.gold_attendance(silver_fixture(spark, sf_dir, "dense"))


@register("gold_attendance_sparse", O.gold_sql("sparse"))
def gold_attendance_sparse(spark, sf_dir):
    return A.gold_attendance(silver_fixture(spark, sf_dir, "sparse"))


@register("gold_attendance_hot_badge", O.gold_sql("hot"))
def gold_attendance_hot_badge(spark, sf_dir):
    """One shared badge holds a third of all swipes; its days are cut into
    time slices, so no task holds a whole day of that badge."""
    return A.gold_attendance(silver_fixture(spark, sf_dir, "hot"))


# ------------------------------------------------------------------ cleaning
from ..operators import clean as C  # noqa: E402
from ..operators import conform as S  # noqa: E402
from ..functions import columns as FN  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

_RAW_DIRTY = O.raw_fixture("sparse", dirty=True, duplicates=True)
_RAW_TEXT = O.raw_fixture("sparse", dirty=True, swipe_as_text=True)
_K = O.q("Employee No")
_KEY, _HAS_KEY = O.stripped(_K), O.has_key(_K)
_WORD_KEY = f"regexp_matches({_KEY}, '[a-zA-Z0-9]')"
_RAW_COLS = ", ".join(O.q(c) for c in O.RAW_NAMES)


def raw_dirty(spark, sf_dir):
    return FX.raw_swipes(FX.read_events(spark, sf_dir), "sparse", dirty=True, duplicates=True)


def bronze_df(spark, sf_dir):
    return C.clean_bronze(raw_dirty(spark, sf_dir))


_BRONZE = O.bronze_from("raw")
_SILVER_CAST = O.silver_cast_from("bronze")


@register("clean_dropna", f"WITH raw AS ({_RAW_DIRTY}) SELECT * FROM raw WHERE {_HAS_KEY}")
def clean_dropna(spark, sf_dir):
    return C.drop_missing_key(raw_dirty(spark, sf_dir))


@register("clean_cast_trim",
          f"WITH raw AS ({_RAW_DIRTY}) SELECT * REPLACE ({_KEY} AS {_K}) FROM raw WHERE {_HAS_KEY}")
def clean_cast_trim(spark, sf_dir):
    return C.cast_trim(C.drop_missing_key(raw_dirty(spark, sf_dir)))


@register("clean_regex_filter",
          f"WITH raw AS ({_RAW_DIRTY}) SELECT * REPLACE ({_KEY} AS {_K}) FROM raw WHERE {_HAS_KEY} AND {_WORD_KEY}")
def clean_regex_filter(spark, sf_dir):
    return C.keep_word_keys(C.cast_trim(C.drop_missing_key(raw_dirty(spark, sf_dir))))


_REASON = f"""CASE WHEN NOT {_HAS_KEY} THEN 'null_key' WHEN NOT {_WORD_KEY} THEN 'no_word_key'
    WHEN {O.swipe_time('"Swipe Date"')} IS NULL THEN 'bad_swipe_date' END"""


@register("clean_metrics", f"""WITH raw AS ({_RAW_TEXT}), p AS (SELECT {_REASON} AS why FROM raw),
c AS (SELECT CAST(COUNT(*) AS BIGINT) AS initial_rows,
    {', '.join(f"CAST(COUNT(*) FILTER (WHERE why = '{w}') AS BIGINT) AS {w}"
               for w in ('null_key', 'no_word_key', 'bad_swipe_date'))},
    CAST(COUNT(*) FILTER (WHERE why IS NULL) AS BIGINT) AS final_rows FROM p)
SELECT *, initial_rows - final_rows AS removed_rows FROM c""")
def clean_metrics(spark, sf_dir):
    raw = FX.raw_swipes(FX.read_events(spark, sf_dir), "sparse", dirty=True, swipe_as_text=True)
    return C.cleaning_counts(C.parse_swipe(raw))


@register("parse_swipe_ts", f"""WITH raw AS ({_RAW_TEXT})
SELECT {_KEY} AS Employee_No, "Swipe Date" AS swipe_text, {O.swipe_time('"Swipe Date"')} AS swipe_ts,
       {O.swipe_time('"Swipe Date"')} IS NULL AS quarantined
FROM raw WHERE {_HAS_KEY} AND {_WORD_KEY}""")
def parse_swipe_ts(spark, sf_dir):
    raw = FX.raw_swipes(FX.read_events(spark, sf_dir), "sparse", dirty=True, swipe_as_text=True)
    raw = C.keep_word_keys(C.cast_trim(C.drop_missing_key(raw)))
    parsed = C.parse_swipe(raw.withColumn("swipe_text", F.col("`Swipe Date`")))
    return parsed.select(
        F.col("`Employee No`").alias("Employee_No"), "swipe_text",
        F.col("`Swipe Date`").alias("swipe_ts"),
        F.col("`Swipe Date`").isNull().alias("quarantined"))


@register("date_bounds", f"""WITH raw AS ({_RAW_DIRTY}), bronze AS ({_BRONZE})
SELECT MIN(Date) AS start_date, MAX(Date) AS end_date, CAST(COUNT(*) AS BIGINT) AS rows FROM bronze""")
def date_bounds(spark, sf_dir):
    return bronze_df(spark, sf_dir).agg(
        F.min("Date").alias("start_date"), F.max("Date").alias("end_date"),
        F.count(F.lit(1)).alias("rows"))


@register("date_parts", f"""WITH raw AS ({_RAW_DIRTY}), bronze AS ({_BRONZE})
SELECT Employee_No, Swipe_Date, Date, time, Year, Day, Month_short_name, Month_Number FROM bronze""")
def date_parts(spark, sf_dir):
    return bronze_df(spark, sf_dir).select(
        "Employee_No", "Swipe_Date", "Date", "time", "Year", "Day", "Month_short_name", "Month_Number")


@register("rename_columns", f"WITH raw AS ({_RAW_DIRTY}) SELECT " + ", ".join(
    f"{O.q(r)} AS {t}" for r, t in zip(O.RAW_NAMES, O.TABLE_NAMES)) + " FROM raw")
def rename_columns(spark, sf_dir):
    return C.rename_columns(raw_dirty(spark, sf_dir))


@register("sanitize_columns", f"""WITH raw AS ({_RAW_DIRTY})
SELECT {_K} AS Employee_No, "Swipe Date" AS Swipe_Date, "Access Card" AS Badge,
       "Door/Address" AS Site_HQ, "Location Type" AS Floor, "Remarks" AS col FROM raw""")
def sanitize_columns(spark, sf_dir):
    raw = raw_dirty(spark, sf_dir).select(
        "`Employee No`", "`Swipe Date`",
        F.col("`Access Card`").alias("Badge #"), F.col("`Door/Address`").alias("Site (HQ)"),
        F.col("`Location Type`").alias("__Floor__"), F.col("Remarks").alias("%"))
    return C.rename_columns(raw)


@register("sanitize_values", f"""WITH raw AS ({_RAW_DIRTY}),
s AS (SELECT {_K} AS Employee_No, "Swipe Date" AS Swipe_Date, Remarks,
      array_to_string(regexp_extract_all(Remarks, '[0-9A-Za-z]+'), '_') AS v FROM raw)
SELECT Employee_No, Swipe_Date, CASE WHEN Remarks IS NULL THEN NULL WHEN v = '' THEN 'col' ELSE v END AS remarks_name
FROM s""")
def sanitize_values(spark, sf_dir):
    raw = raw_dirty(spark, sf_dir)
    return raw.select(F.col("`Employee No`").alias("Employee_No"), F.col("`Swipe Date`").alias("Swipe_Date"),
                      FN.sanitize_value(F.col("Remarks")).alias("remarks_name"))


@register("bronze_clean", f"WITH raw AS ({_RAW_DIRTY}) {_BRONZE}")
def bronze_clean(spark, sf_dir):
    return bronze_df(spark, sf_dir)


# -------------------------------------------------------------------- silver
@register("silver_cast", f"WITH raw AS ({_RAW_DIRTY}), bronze AS ({_BRONZE}) {_SILVER_CAST}")
def silver_cast(spark, sf_dir):
    return S.silver_cast(bronze_df(spark, sf_dir))


@register("digits_only", f"""WITH raw AS ({_RAW_DIRTY}), bronze AS ({_BRONZE})
SELECT Employee_No, Swipe_Date, Access_Card AS card_raw,
       regexp_replace(Access_Card, '[^0-9]', '', 'g') AS card_digits FROM bronze""")
def digits_only(spark, sf_dir):
    b = bronze_df(spark, sf_dir)
    return b.select("Employee_No", "Swipe_Date", F.col("Access_Card").alias("card_raw"),
                    FN.digits_only(F.col("Access_Card")).alias("card_digits"))


# --- fixed values: the calendar range used by the range queries ---
RANGE_START, RANGE_END = "2024-01-08", "2024-01-21"


@register("filter_date_between", f"""WITH raw AS ({_RAW_DIRTY}), bronze AS ({_BRONZE})
SELECT * FROM bronze WHERE Date BETWEEN DATE '{RANGE_START}' AND DATE '{RANGE_END}'""")
def filter_date_between(spark, sf_dir):
    return bronze_df(spark, sf_dir).where(F.col("Date").between(F.lit(RANGE_START).cast("date"),
                                                               F.lit(RANGE_END).cast("date")))


@register("dedup_latest", f"""WITH raw AS ({_RAW_DIRTY}), bronze AS ({_BRONZE}), sc AS ({_SILVER_CAST})
{O.dedup_from('sc')}""")
def dedup_latest(spark, sf_dir):
    return S.dedup_latest(S.silver_cast(bronze_df(spark, sf_dir)))


@register("silver_conform", f"""WITH raw AS ({_RAW_DIRTY}), bronze AS ({_BRONZE}),
sc AS ({_SILVER_CAST.replace('FROM bronze', f"FROM bronze WHERE Date BETWEEN DATE '{RANGE_START}' AND DATE '{RANGE_END}'")})
{O.dedup_from('sc')}""")
def silver_conform(spark, sf_dir):
    return S.conform_silver(bronze_df(spark, sf_dir), RANGE_START, RANGE_END)


# ------------------------------------------------------------ gold, by stage
from ..operators import islands as I  # noqa: E402

_DAY_KEYS = "Employee_No, work_date"


def swipes_dense(spark, sf_dir):
    return A.approved_swipes(silver_fixture(spark, sf_dir, "dense"))


def day_dense(spark, sf_dir):
    return A.day_measures(swipes_dense(spark, sf_dir))


@register("filter_approved", O.stage_sql(
    "SELECT Employee_No, Employee_Name, swipe_ts, work_date, io, Swipe_Type, Swipe_Date FROM swipes"))
def filter_approved(spark, sf_dir):
    return swipes_dense(spark, sf_dir).select(
        "Employee_No", "Employee_Name", "swipe_ts", "work_date", "io", "Swipe_Type", "Swipe_Date")


_TS_SQL = "strptime(strftime(Date, '%Y-%m-%d') || ' ' || time, '%Y-%m-%d %H:%M:%S')"


@register("build_swipe_ts", f"""WITH silver AS ({O.silver_fixture('dense')})
SELECT Employee_No, Swipe_Date, Date, time, {_TS_SQL} AS swipe_ts FROM silver""")
def build_swipe_ts(spark, sf_dir):
    s = silver_fixture(spark, sf_dir, "dense")
    return s.select("Employee_No", "Swipe_Date", "Date", "time",
                    FN.swipe_timestamp(F.col("Date"), F.col("time")).alias("swipe_ts"))


@register("work_date_cutoff", f"""WITH silver AS ({O.silver_fixture('dense')}),
t AS (SELECT Employee_No, Swipe_Date, {_TS_SQL} AS swipe_ts FROM silver)
SELECT Employee_No, Swipe_Date, swipe_ts,
       CASE WHEN hour(swipe_ts) < 5 THEN CAST(swipe_ts AS DATE) - 1 ELSE CAST(swipe_ts AS DATE) END
           AS work_date FROM t""")
def work_date_cutoff(spark, sf_dir):
    s = silver_fixture(spark, sf_dir, "dense")
    ts = FN.swipe_timestamp(F.col("Date"), F.col("time"))
    return s.select("Employee_No", "Swipe_Date", ts.alias("swipe_ts"),
                    FN.work_date(ts).alias("work_date"))


@register("normalize_io", f"""WITH raw AS ({_RAW_DIRTY}), bronze AS ({_BRONZE})
SELECT Employee_No, Swipe_Date, In_Out, upper(trim(In_Out)) AS io,
       In_Out IN ('In', 'Out', 'IN', 'OUT') AS accepted_raw,
       upper(trim(In_Out)) IN ('IN', 'OUT') AS accepted_normalized FROM bronze""")
def normalize_io(spark, sf_dir):
    b = bronze_df(spark, sf_dir)
    io = FN.normalize_io(F.col("In_Out"))
    return b.select("Employee_No", "Swipe_Date", "In_Out", io.alias("io"),
                    F.col("In_Out").isin("In", "Out", "IN", "OUT").alias("accepted_raw"),
                    io.isin("IN", "OUT").alias("accepted_normalized"))


@register("islands_lag", O.stage_sql(
    "SELECT Employee_No, work_date, swipe_ts, io, Swipe_Date, prev_io, is_start, grp FROM islands"))
def islands_lag(spark, sf_dir):
    return I.islands_lag(swipes_dense(spark, sf_dir)).select(
        "Employee_No", "work_date", "swipe_ts", "io", "Swipe_Date", "prev_io", "is_start", "grp")


@register("islands_rownum", O.stage_sql(f"""SELECT Employee_No, work_date, swipe_ts, io, Swipe_Date,
    CAST(ROW_NUMBER() OVER ({O.DAY_PART} ORDER BY {O.SWIPE_ORDER}) AS BIGINT) AS rn_all,
    CAST(ROW_NUMBER() OVER (PARTITION BY Employee_No, work_date, io ORDER BY {O.SWIPE_ORDER}) AS BIGINT)
        AS rn_io,
    CAST(ROW_NUMBER() OVER ({O.DAY_PART} ORDER BY {O.SWIPE_ORDER})
       - ROW_NUMBER() OVER (PARTITION BY Employee_No, work_date, io ORDER BY {O.SWIPE_ORDER}) AS BIGINT)
        AS grp
FROM swipes"""))
def islands_rownum(spark, sf_dir):
    return I.islands_rownum(swipes_dense(spark, sf_dir)).select(
        "Employee_No", "work_date", "swipe_ts", "io", "Swipe_Date", "rn_all", "rn_io", "grp")


def collapsed_dense(spark, sf_dir):
    return I.collapse(I.islands_lag(swipes_dense(spark, sf_dir)))


def collapsed_dense_once(spark, sf_dir):
    """Collapsed islands, computed once for plans that use them twice."""
    from ..session import materialize
    return materialize(collapsed_dense(spark, sf_dir))


@register("collapse_islands", O.stage_sql(
    "SELECT Employee_No, work_date, io, seq AS grp, day_name AS Employee_Name, effective_ts FROM one_run"))
def collapse_islands(spark, sf_dir):
    return collapsed_dense(spark, sf_dir).select(
        "Employee_No", "work_date", "io", "grp", "Employee_Name", "effective_ts")


@register("collapsed_seq", O.stage_sql(
    "SELECT Employee_No, work_date, io, effective_ts, seq FROM one_run"))
def collapsed_seq(spark, sf_dir):
    return collapsed_dense(spark, sf_dir).select("Employee_No", "work_date", "io", "effective_ts", "seq")


@register("first_last_value", O.stage_sql(
    "SELECT Employee_No, work_date, seq, io, first_io AS first_io_temp, last_io AS last_io_temp FROM one_run"))
def first_last_value(spark, sf_dir):
    return I.first_last_value(collapsed_dense_once(spark, sf_dir)).select(
        "Employee_No", "work_date", "seq", "io", "first_io_temp", "last_io_temp")


@register("pair_lead_lag", O.stage_sql(
    "SELECT Employee_No, work_date, seq, io, effective_ts, end_ts, end_io, prev_io FROM one_run"))
def pair_lead_lag(spark, sf_dir):
    return I.pairs(collapsed_dense_once(spark, sf_dir)).select(
        "Employee_No", "work_date", "seq", "io", "effective_ts", "end_ts", "end_io", "prev_io")


@register("in_intervals", O.stage_sql("SELECT Employee_No, work_date, seq, dur_seconds FROM gaps WHERE io = 'IN'"))
def in_intervals(spark, sf_dir):
    return I.in_intervals(I.pairs(collapsed_dense_once(spark, sf_dir)))


@register("out_intervals", O.stage_sql(
    "SELECT Employee_No, work_date, seq, dur_seconds FROM gaps WHERE io = 'OUT' AND prev_io = 'IN'"))
def out_intervals(spark, sf_dir):
    return I.out_intervals(I.pairs(collapsed_dense_once(spark, sf_dir)))


@register("sum_in_seconds", O.stage_sql(
    "SELECT Employee_No, work_date, inside AS in_seconds FROM day_sums WHERE inside IS NOT NULL"))
def sum_in_seconds(spark, sf_dir):
    return I.sum_seconds(I.in_intervals(I.pairs(collapsed_dense_once(spark, sf_dir))), "in_seconds")


@register("sum_out_seconds", O.stage_sql(
    "SELECT Employee_No, work_date, outside AS out_seconds FROM day_sums WHERE outside IS NOT NULL"))
def sum_out_seconds(spark, sf_dir):
    return I.sum_seconds(I.out_intervals(I.pairs(collapsed_dense_once(spark, sf_dir))), "out_seconds")


@register("day_first_last", O.stage_sql(
    "SELECT Employee_No, Employee_Name, work_date, first_io, last_io, min_in_ts, max_out_ts FROM day_facts"))
def day_first_last(spark, sf_dir):
    return I.day_first_last(collapsed_dense(spark, sf_dir)).drop("min_in_sec", "max_out_sec")


@register("first_swipe", O.stage_sql("SELECT Employee_No, work_date, first_swipe_type FROM day_facts"))
def first_swipe(spark, sf_dir):
    return I.first_swipe(swipes_dense(spark, sf_dir))


_FINAL = O.stage_sql("SELECT * FROM day_measures")


@register("left_join_day_measures", _FINAL)
def left_join_day_measures(spark, sf_dir):
    return I.day_measures_joined(swipes_dense(spark, sf_dir))


@register("day_measures_salted", _FINAL)
def day_measures_salted(spark, sf_dir):
    return day_dense(spark, sf_dir)


@register("gold_attendance_joined", O.gold_sql("dense"))
def gold_attendance_joined(spark, sf_dir):
    return A.gold_columns(I.day_measures_joined(swipes_dense(spark, sf_dir)))


@register("coalesce_zero", O.stage_sql(
    "SELECT Employee_No, work_date, in_seconds, out_seconds FROM day_measures"))
def coalesce_zero(spark, sf_dir):
    return day_dense(spark, sf_dir).select(*A.DAY, "in_seconds", "out_seconds")


@register("raw_full_span", O.stage_sql(
    "SELECT Employee_No, work_date, first_io, last_io, raw_full_span_seconds FROM day_measures"))
def raw_full_span(spark, sf_dir):
    return day_dense(spark, sf_dir).select(*A.DAY, "first_io", "last_io", "raw_full_span_seconds")


@register("filter_has_swipe", O.stage_sql(
    "SELECT Employee_No, work_date, min_in_ts, max_out_ts FROM day_measures"))
def filter_has_swipe(spark, sf_dir):
    return day_dense(spark, sf_dir).select(*A.DAY, "min_in_ts", "max_out_ts")


@register("web_cap", O.measured_projection(
    "Employee_No, work_date, first_swipe_type, in_seconds, in_cap, raw_full_span_seconds, span_cap"))
def web_cap(spark, sf_dir):
    d = day_dense(spark, sf_dir)
    t = F.col("first_swipe_type")
    return d.select(*A.DAY, "first_swipe_type", "in_seconds",
                    FN.web_capped(F.col("in_seconds"), t).alias("in_cap"), "raw_full_span_seconds",
                    FN.web_capped(F.col("raw_full_span_seconds"), t).alias("span_cap"))


def _gold_cols(cols):
    def q(spark, sf_dir):
        return A.gold_columns(day_dense(spark, sf_dir)).select(*A.DAY, *cols)
    return q


for _name, _cols in {
    "sign_in_method": ["sign_in_method"],
    "swipe_status": ["swipe_status"],
    "in_out_time": ["in_time", "out_time"],
    "format_hhmm": ["in_duration", "out_duration", "full_span"],
    "productive_ot_sf": ["Productive_Overtime", "Productive_Shortfall"],
    "overall_ot_sf": ["Overall_Overtime", "Overall_Shortfall"],
    "minute_of_day": ["in_time_minutes", "out_time_minutes"],
    "duration_minutes": ["in_duration_minutes", "out_duration_minutes"],
    "ot_sf_minutes": ["Productive_Overtime_Minutes", "Productive_Shortfall_Minutes",
                      "Overall_Overtime_Minutes", "Overall_Shortfall_Minutes"],
}.items():
    register(_name, O.gold_projection(", ".join([_DAY_KEYS, *_cols])))(_gold_cols(_cols))


# ------------------------------------------------------------------ upserts
from ..operators import upsert as U  # noqa: E402
from ..schemas import BRONZE_KEYS, GOLD_MINUTE_COLUMNS, GOLD_SCHEMA  # noqa: E402
from ..session import work_path  # noqa: E402
from ..operators import paging as PG  # noqa: E402
from . import batch as B  # noqa: E402
from concurrent.futures import ThreadPoolExecutor  # noqa: E402


def _batches(spark, sf_dir):
    ev = FX.read_events(spark, sf_dir)
    return FX.raw_batch(ev, 1), FX.raw_batch(ev, 2)


def _bronze_two(spark, sf_dir):
    """Upsert both batches into a fresh bronze table; returns (path, second result)."""
    path = work_path(spark, "bronze")
    r1, r2 = _batches(spark, sf_dir)
    U.upsert(spark, path, C.clean_bronze(r1), BRONZE_KEYS, "Date", latest="Received_On")
    res = U.upsert(spark, path, C.clean_bronze(r2), BRONZE_KEYS, "Date", latest="Received_On")
    return path, res


def _chain_two(spark, sf_dir, replace_days=False):
    root = work_path(spark, "medallion")
    t = B.Tables(f"{root}/bronze", f"{root}/silver", f"{root}/gold")
    r1, r2 = _batches(spark, sf_dir)
    B.run_batch(spark, r1, t, replace_days=replace_days)
    res2 = B.run_batch(spark, r2, t, replace_days=replace_days)
    return t, res2


_BRONZE_COLS = ", ".join(O.BRONZE_NAMES)


@register("upsert_bronze", f"SELECT {_BRONZE_COLS} FROM ({O.bronze_after_two()})")
def upsert_bronze(spark, sf_dir):
    path, _ = _bronze_two(spark, sf_dir)
    return U.read_table(spark, path).select(*O.BRONZE_NAMES)


@register("upsert_action_counts", f"""WITH b1 AS ({O.bronze_batch(1)}), b2 AS ({O.bronze_batch(2)}),
t AS (SELECT * FROM b1 WHERE Date IN (SELECT DISTINCT Date FROM b2)),
j AS (SELECT CASE WHEN t.Employee_No IS NULL THEN 'insert'
                  WHEN b2.Employee_No IS NULL THEN 'target_only'
                  WHEN {' OR '.join(f't.{c} IS DISTINCT FROM b2.{c}' for c in O.BRONZE_NAMES
                                   if c not in ('Employee_No', 'Swipe_Date'))} THEN 'update'
                  ELSE 'unchanged' END AS a
      FROM t FULL OUTER JOIN b2 ON t.Employee_No = b2.Employee_No AND t.Swipe_Date = b2.Swipe_Date)
SELECT CAST(COUNT(*) FILTER (WHERE a = 'insert') AS BIGINT) AS insert,
       CAST(COUNT(*) FILTER (WHERE a = 'update') AS BIGINT) AS update,
       CAST(COUNT(*) FILTER (WHERE a = 'unchanged') AS BIGINT) AS unchanged,
       CAST(COUNT(*) FILTER (WHERE a = 'target_only') AS BIGINT) AS target_only,
       CAST(COUNT(*) FILTER (WHERE a = 'delete') AS BIGINT) AS "delete"
FROM j""")
def upsert_action_counts(spark, sf_dir):
    _, res = _bronze_two(spark, sf_dir)
    return spark.createDataFrame([[res.counts[a] for a in U.ACTIONS]], ", ".join(f"`{a}` long" for a in U.ACTIONS))


@register("change_detect", f"""WITH b1 AS ({O.bronze_batch(1)}), b2 AS ({O.bronze_batch(2)})
SELECT COALESCE(b1.Employee_No, b2.Employee_No) AS Employee_No,
       COALESCE(b1.Swipe_Date, b2.Swipe_Date) AS Swipe_Date,
       CASE WHEN b1.Employee_No IS NULL THEN 'insert' WHEN b2.Employee_No IS NULL THEN 'target_only'
            WHEN {' OR '.join(f'b1.{c} IS DISTINCT FROM b2.{c}' for c in O.BRONZE_NAMES
                             if c not in ('Employee_No', 'Swipe_Date'))} THEN 'update'
            ELSE 'unchanged' END AS _action
FROM b1 FULL OUTER JOIN b2 ON b1.Employee_No = b2.Employee_No AND b1.Swipe_Date = b2.Swipe_Date""")
def change_detect(spark, sf_dir):
    r1, r2 = _batches(spark, sf_dir)
    b1 = U.dedup_by(C.clean_bronze(r1), BRONZE_KEYS, "Received_On")
    b2 = U.dedup_by(C.clean_bronze(r2), BRONZE_KEYS, "Received_On")
    return U.merge_plan(b1, b2, BRONZE_KEYS).select(*BRONZE_KEYS, "_action")


_SILVER_AFTER = O.silver_cast_from(f"({O.bronze_after_two()})")


@register("upsert_silver", _SILVER_AFTER)
def upsert_silver(spark, sf_dir):
    t, _ = _chain_two(spark, sf_dir)
    return U.read_table(spark, t.silver).select(*O.SILVER_NAMES)


def _gold_after_two_sql() -> str:
    g2 = O.gold_over(_SILVER_AFTER)
    g1 = O.gold_over(O.silver_cast_from(f"({O.bronze_batch(1)})"))
    return f"""SELECT * FROM ({g2})
UNION ALL
SELECT * FROM ({g1}) g1 WHERE NOT EXISTS (
    SELECT 1 FROM ({g2}) g2 WHERE g2.Employee_No = g1.Employee_No AND g2.work_date = g1.work_date)"""


@register("upsert_gold", _gold_after_two_sql())
def upsert_gold(spark, sf_dir):
    t, _ = _chain_two(spark, sf_dir)
    return U.read_table(spark, t.gold, GOLD_SCHEMA)


@register("upsert_gold_replace_days", O.gold_over(_SILVER_AFTER))
def upsert_gold_replace_days(spark, sf_dir):
    """Same two loads, with recomputed work days replacing their gold rows:
    a day whose swipes were all rejected by the second load disappears."""
    t, _ = _chain_two(spark, sf_dir, replace_days=True)
    return U.read_table(spark, t.gold, GOLD_SCHEMA)


_COERCED = ", ".join(["Employee_No", "Employee_Name", "work_date", "sign_in_method", "swipe_status",
                      "in_time", "out_time", "in_duration", "out_duration", "full_span",
                      "Productive_Overtime", "Productive_Shortfall", "Overall_Overtime",
                      "Overall_Shortfall"]
                     + [f"CAST(COALESCE(TRY_CAST({c} AS DOUBLE), 0) AS BIGINT) AS {c}"
                        for c in GOLD_MINUTE_COLUMNS])


def coerce_minutes_df(df):
    return A.minutes_as_integers(df)


_B1_KEPT = f"""b1.Employee_No = b2.Employee_No AND b1.Swipe_Date = b2.Swipe_Date"""


def _wide(n, table):
    """Bronze of one batch; batch 1 has a badge, batch 2 a gate instead."""
    own = {1: "'B-' || Employee_No AS badge, CAST(NULL AS VARCHAR) AS gate",
           2: "CAST(NULL AS VARCHAR) AS badge, 'G-' || Day AS gate"}[n]
    return f"{table} AS (SELECT Employee_No, Swipe_Date, Date, Remarks, {own} FROM ({O.bronze_batch(n)}))"


@register("upsert_new_columns", f"""WITH {_wide(1, 'b1')}, {_wide(2, 'b2')}
SELECT COALESCE(b2.Employee_No, b1.Employee_No) AS Employee_No, COALESCE(b2.Swipe_Date, b1.Swipe_Date) AS Swipe_Date,
       COALESCE(b2.Date, b1.Date) AS Date,
       CASE WHEN b2.Employee_No IS NULL THEN b1.Remarks ELSE b2.Remarks END AS Remarks, b1.badge, b2.gate
FROM b1 FULL OUTER JOIN b2 ON {_B1_KEPT}""")
def upsert_new_columns(spark, sf_dir):
    """A load with an extra column, then one without it that brings another:
    the table keeps both columns and every value."""
    path = work_path(spark, "wide")
    for n, raw in enumerate(_batches(spark, sf_dir), 1):
        own = (F.concat(F.lit("B-"), "Employee_No").alias("badge") if n == 1
               else F.concat(F.lit("G-"), F.col("Day").cast("string")).alias("gate"))
        U.upsert(spark, path, U.dedup_by(C.clean_bronze(raw), BRONZE_KEYS, "Received_On")
                 .select("Employee_No", "Swipe_Date", "Date", "Remarks", own), BRONZE_KEYS, "Date", unique_keys=True)
    return U.read_table(spark, path).select("Employee_No", "Swipe_Date", "Date", "Remarks", "badge", "gate")


@register("upsert_after_interruption", f"SELECT {_BRONZE_COLS} FROM ({O.bronze_after_two()})")
def upsert_after_interruption(spark, sf_dir):
    """The second load stops with its rows written and no version that names
    them: the table is still that of the first load.  Running it again gives the
    table of a clean run."""
    path = work_path(spark, "stopped")
    r1, r2 = (C.clean_bronze(r) for r in _batches(spark, sf_dir))
    U.upsert(spark, path, r1, BRONZE_KEYS, "Date", latest="Received_On")
    U.upsert(spark, path, r2, BRONZE_KEYS, "Date", latest="Received_On", commit=False)
    U.upsert(spark, path, r2, BRONZE_KEYS, "Date", latest="Received_On")
    return U.read_table(spark, path).select(*O.BRONZE_NAMES)


@register("upsert_newer_only", f"""WITH b AS (SELECT * FROM ({O.bronze_batch(1)}) UNION ALL SELECT * FROM ({O.bronze_batch(2)}))
{O.dedup_from('b', cols=O.BRONZE_NAMES)}""")
def upsert_newer_only(spark, sf_dir):
    """The later re-export is loaded first; copies received earlier do not
    overwrite it, so the order of loads does not matter."""
    path = work_path(spark, "newer")
    for raw in reversed(_batches(spark, sf_dir)):
        U.upsert(spark, path, C.clean_bronze(raw), BRONZE_KEYS, "Date", latest="Received_On", newer_by="Received_On")
    return U.read_table(spark, path).select(*O.BRONZE_NAMES)


@register("upsert_two_writers", f"""WITH b AS (SELECT * FROM ({O.bronze_batch(1)}) UNION ALL SELECT * FROM ({O.bronze_batch(2)}))
{O.dedup_from('b', cols=O.BRONZE_NAMES)}""")
def upsert_two_writers(spark, sf_dir):
    """Both loads at the same time into one table: the one that commits second
    looks at what the first did, and both are in."""
    path = work_path(spark, "writers")

    def load(raw):
        return U.upsert(spark, path, C.clean_bronze(raw), BRONZE_KEYS, "Date", latest="Received_On", newer_by="Received_On")
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(load, _batches(spark, sf_dir)))
    return U.read_table(spark, path).select(*O.BRONZE_NAMES)


@register("upsert_compacted", f"SELECT {_BRONZE_COLS} FROM ({O.bronze_after_two()})")
def upsert_compacted(spark, sf_dir):
    """Two loads leave the changed rows of each in folders of their own; compaction writes
    the days that lie in several folders anew, with the same rows."""
    path, _ = _bronze_two(spark, sf_dir)
    U.compact(spark, path)
    return U.read_table(spark, path).select(*O.BRONZE_NAMES)


_FED = ["Remarks", "Status", "Received_On"]


@register("change_feed_rows", f"""WITH b1 AS ({O.bronze_batch(1)}), b2 AS ({O.bronze_batch(2)})
SELECT b2.Employee_No, b2.Swipe_Date, CASE WHEN b1.Employee_No IS NULL THEN 'insert' ELSE 'update' END AS action,
       {', '.join(f'b1.{c} AS old_{c}, b2.{c} AS new_{c}' for c in _FED)},
       CASE WHEN b1.Employee_No IS NULL THEN '' ELSE concat_ws(',',
            {', '.join(f"CASE WHEN b1.{c} IS DISTINCT FROM b2.{c} THEN '{c}' END" for c in _FED)}) END AS changed
FROM b2 LEFT JOIN b1 ON {_B1_KEPT}
WHERE b1.Employee_No IS NULL OR {' OR '.join(f'b1.{c} IS DISTINCT FROM b2.{c}' for c in O.BRONZE_NAMES
                                              if c not in ('Employee_No', 'Swipe_Date'))}""")
def change_feed_rows(spark, sf_dir):
    """What the second load did to bronze, read from the feed: action, old and
    new values, and which of three columns differ."""
    path, res = _bronze_two(spark, sf_dir)
    feed = U.change_feed(spark, path, after=res.version - 1)
    differs = [F.when(FN.is_distinct(F.col(f"_old.{c}"), F.col(c)), F.lit(c)) for c in _FED]
    return feed.select(
        *BRONZE_KEYS, F.col("_action").alias("action"),
        *[x for c in _FED for x in (F.col(f"_old.{c}").alias(f"old_{c}"), F.col(c).alias(f"new_{c}"))],
        F.when(F.col("_action") == "insert", "").otherwise(F.concat_ws(",", *differs)).alias("changed"))


@register("medallion_two_batches", f"""SELECT {_COERCED} FROM ({_gold_after_two_sql()})
WHERE work_date BETWEEN DATE '{FX.BATCH2_FROM}' AND (SELECT MAX(CAST(ts AS DATE)) FROM events)""")
def medallion_two_batches(spark, sf_dir):
    """Two overlapping loads through bronze, silver and gold; the report of
    the second load (its date range, minute columns as integers)."""
    t, res = _chain_two(spark, sf_dir)
    return coerce_minutes_df(B.gold_for_range(spark, t, res.start_date, res.end_date))


_SILVER_FROM_DIRTY = O.dedup_from(f"({O.silver_cast_from(f'(WITH raw AS ({_RAW_DIRTY}) {_BRONZE})')})")


@register("gold_from_export", O.gold_over(_SILVER_FROM_DIRTY))
def gold_from_export(spark, sf_dir):
    """Raw export (dirty rows, re-sent swipes) -> bronze -> silver -> gold,
    without tables in between; ' In ' is not a valid direction (raw rule)."""
    return A.gold_attendance(S.conform_silver(bronze_df(spark, sf_dir)))


@register("gold_from_export_normalized_io", O.gold_over(_SILVER_FROM_DIRTY, normalize_io=True))
def gold_from_export_normalized_io(spark, sf_dir):
    """Same, with directions trimmed and upper-cased before they are tested."""
    from ..config import AttendanceConfig
    cfg = AttendanceConfig(normalize_io_first=True)
    return A.gold_attendance(S.conform_silver(bronze_df(spark, sf_dir)), cfg)


@register("coerce_minutes", f"SELECT {_COERCED} FROM ({O.gold_sql('dense')})")
def coerce_minutes(spark, sf_dir):
    return coerce_minutes_df(gold_attendance(spark, sf_dir))


# ------------------------------------------------------- sources and sinks
from ..schemas import RAW_SCHEMA, ddl  # noqa: E402
from ..sources import files as IO  # noqa: E402
from ..streaming import incremental as ST  # noqa: E402

_BRONZE_DIRTY = f"WITH raw AS ({_RAW_DIRTY}) {_BRONZE}"


@register("scan_csv_explicit_schema", _BRONZE_DIRTY)
def scan_csv_explicit_schema(spark, sf_dir):
    """Bronze staged as headerless, fully quoted CSV and read back with an
    explicit schema (no inference pass)."""
    b = bronze_df(spark, sf_dir)
    path = IO.write_csv_quoted(b, work_path(spark, "staging-csv"), header=False)
    return IO.read_csv(spark, path, ddl(b.schema), header=False)


@register("sink_csv_quoted", f"WITH raw AS ({_RAW_DIRTY}) SELECT * FROM raw")
def sink_csv_quoted(spark, sf_dir):
    """Raw export (names with spaces and slashes, text with quotes) through a
    quoted CSV with header, read back."""
    raw = raw_dirty(spark, sf_dir)
    path = IO.write_csv_quoted(raw, work_path(spark, "export-csv"), header=True)
    return IO.read_csv(spark, path, RAW_SCHEMA, header=True)


@register("append_csv_merge_schema", f"""WITH raw AS ({_RAW_DIRTY})
SELECT {_K} AS Employee_No, "Swipe Date" AS Swipe_Date, "Longitude" AS Longitude,
       CASE WHEN "Swipe Date" >= TIMESTAMP '2024-01-15' THEN "Swipe Type" END AS Swipe_Type
FROM raw""")
def append_csv_merge_schema(spark, sf_dir):
    """Two CSV loads with different headers appended to one typed Parquet table
    (time stamp and double); read back with merged schema (the first load has
    no Swipe_Type)."""
    raw = raw_dirty(spark, sf_dir).select(
        F.col("`Employee No`").alias("Employee_No"), F.col("`Swipe Date`").alias("Swipe_Date"),
        "Longitude", F.col("`Swipe Type`").alias("Swipe_Type"))
    cut = F.col("Swipe_Date") >= F.lit("2024-01-15").cast("timestamp_ntz")
    a = IO.write_csv_quoted(raw.where(~cut).drop("Swipe_Type"), work_path(spark, "load-a"))
    b = IO.write_csv_quoted(raw.where(cut), work_path(spark, "load-b"))
    table = work_path(spark, "appended")
    IO.create_if_missing(raw.drop("Swipe_Type").limit(0), table)
    IO.load_csv_append(spark, a, table)
    IO.load_csv_append(spark, b, table)
    return IO.read_merged(spark, table).select("Employee_No", "Swipe_Date", "Longitude", "Swipe_Type")


_NUMBER = """CASE WHEN event_id % 7 = 0 THEN 'gate ' || event_id WHEN event_id % 11 = 0 THEN NULL
             ELSE CAST(event_id AS VARCHAR) END"""


@register("append_csv_rescue", f"""WITH raw AS ({O.raw_fixture('sparse', dirty=True, keep_event=True)}),
r AS (SELECT event_id, {_K} AS k, {_NUMBER} AS n, 'day ' || event_id AS d FROM raw)
SELECT k AS Employee_No, TRY_CAST(n AS BIGINT) AS Badge, TRY_CAST(NULL AS DATE) AS Since,
       CASE WHEN n LIKE 'gate%' THEN '{{"Badge":"' || n || '","Since":"' || d || '"}}' ELSE '{{"Since":"' || d || '"}}' END AS _rescued
FROM r""")
def append_csv_rescue(spark, sf_dir):
    """Cells that do not read as their type stay as text in one column; a second
    load of the same files, each file once, adds nothing."""
    raw = FX.raw_swipes(FX.read_events(spark, sf_dir), "sparse", dirty=True, keep_event_id=True)
    n = F.col("event_id").cast("string")
    number = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("gate "), n)).when(F.col("event_id") % 11 != 0, n)
    path = IO.write_csv_quoted(raw.select(F.col("`Employee No`").alias("Employee_No"), number.alias("Badge"),
                                          F.concat(F.lit("day "), n).alias("Since")), work_path(spark, "load"))
    table = work_path(spark, "rescued")
    for _ in range(2):
        IO.load_csv_append(spark, path, table, {"Badge": "bigint", "Since": "date"}, force=False)
    return IO.read_merged(spark, table).select("Employee_No", "Badge", "Since", IO.RESCUED)


def _gold_table(spark, sf_dir, density="sparse"):
    """Gold of the sparse fixture written as a table partitioned by work_date."""
    path = work_path(spark, "gold")
    g = A.gold_attendance(silver_fixture(spark, sf_dir, density))
    IO.create_if_missing(g, path, "work_date")
    return path


_GOLD_SPARSE = O.gold_sql("sparse")


@register("scan_parquet", _GOLD_SPARSE)
def scan_parquet(spark, sf_dir):
    return U.read_table(spark, _gold_table(spark, sf_dir), GOLD_SCHEMA)


@register("create_if_missing", _GOLD_SPARSE)
def create_if_missing(spark, sf_dir):
    """Second create of an existing table changes nothing (rows not doubled)."""
    path = _gold_table(spark, sf_dir)
    IO.create_if_missing(A.gold_attendance(silver_fixture(spark, sf_dir, "sparse")), path, "work_date")
    return U.read_table(spark, path, GOLD_SCHEMA)


@register("schema_clone_empty", f"WITH raw AS ({_RAW_DIRTY}), bronze AS ({_BRONZE}) {_SILVER_CAST}")
def schema_clone_empty(spark, sf_dir):
    """A table cloned with its columns and no rows, then filled from its source."""
    path, rows = work_path(spark, "silver-clone"), S.silver_cast(bronze_df(spark, sf_dir))
    IO.create_if_missing(rows.limit(0), path)
    rows.write.mode("append").parquet(path)
    return spark.read.schema(S.SILVER_SCHEMA).parquet(path)


@register("table_count", f"SELECT CAST(COUNT(*) AS BIGINT) AS cnt FROM ({_BRONZE_DIRTY})")
def table_count(spark, sf_dir):
    return bronze_df(spark, sf_dir).agg(F.count(F.lit(1)).alias("cnt"))


@register("exists_probe", f"SELECT 1 AS probe FROM ({_GOLD_SPARSE}) LIMIT 1")
def exists_probe(spark, sf_dir):
    return U.read_table(spark, _gold_table(spark, sf_dir), GOLD_SCHEMA).select(F.lit(1).alias("probe")).limit(1)


@register("gold_range_read", f"""SELECT * FROM ({_GOLD_SPARSE})
WHERE work_date BETWEEN DATE '{RANGE_START}' AND DATE '{RANGE_END}' ORDER BY Employee_No, work_date""")
def gold_range_read(spark, sf_dir):
    t = B.Tables("", "", _gold_table(spark, sf_dir))
    return B.gold_for_range(spark, t, RANGE_START, RANGE_END)


# --- fixed values: report page size and the page read ---
PAGE_SIZE, PAGE_INDEX = 6000, 2


@register("page_limit_offset", f"""SELECT * FROM ({_GOLD_SPARSE}) ORDER BY Employee_No, work_date
LIMIT {PAGE_SIZE} OFFSET {PAGE_SIZE * PAGE_INDEX}""")
def page_limit_offset(spark, sf_dir):
    g = U.read_table(spark, _gold_table(spark, sf_dir), GOLD_SCHEMA)
    return g.orderBy("Employee_No", "work_date").offset(PAGE_SIZE * PAGE_INDEX).limit(PAGE_SIZE)


@register("page_by_index", f"""SELECT * FROM ({_GOLD_SPARSE}) ORDER BY Employee_No, work_date
LIMIT {PAGE_SIZE} OFFSET {PAGE_SIZE * PAGE_INDEX}""")
def page_by_index(spark, sf_dir):
    """The same page read by position from stored ranges of the order."""
    path = PG.build_page_index(A.gold_attendance(silver_fixture(spark, sf_dir, "sparse")), ["Employee_No", "work_date"],
                               work_path(spark, "pages"))
    return PG.read_page(spark, path, PAGE_SIZE * PAGE_INDEX, PAGE_SIZE, GOLD_SCHEMA)


@register("preview_head", f"SELECT * FROM ({_GOLD_SPARSE}) ORDER BY Employee_No, work_date LIMIT 5")
def preview_head(spark, sf_dir):
    return A.gold_attendance(silver_fixture(spark, sf_dir, "sparse")).orderBy("Employee_No", "work_date").limit(5)


@register("describe_table", " UNION ALL ".join(
    f"SELECT '{f.name}' AS col_name, '{f.dataType.simpleString()}' AS data_type, "
    f"CAST(COUNT({f.name}) AS BIGINT) AS filled, CAST(COUNT(DISTINCT {f.name}) AS BIGINT) AS different FROM g"
    for f in GOLD_SCHEMA.fields).join((f"WITH g AS ({_GOLD_SPARSE}) ", "")))
def describe_table(spark, sf_dir):
    """Columns and types of the gold table as rows, with how many rows fill
    each column and how many values it has."""
    g = U.read_table(spark, _gold_table(spark, sf_dir), GOLD_SCHEMA)
    cells = g.select(F.explode(F.array(*[
        F.struct(F.lit(f.name).alias("col_name"), F.lit(f.dataType.simpleString()).alias("data_type"),
                 F.col(f.name).cast("string").alias("v")) for f in GOLD_SCHEMA.fields])).alias("c"))
    return cells.groupBy("c.col_name", "c.data_type").agg(
        F.count("c.v").alias("filled"), F.count_distinct("c.v").alias("different"))


_POS_NAMES = ["emp", "name", "day"]


@register("positional_rename", "SELECT Employee_No AS emp, Employee_Name AS name, work_date AS day, "
          "in_duration AS col_3, out_duration AS col_4 FROM (" + _GOLD_SPARSE + ")")
def positional_rename(spark, sf_dir):
    g = A.gold_attendance(silver_fixture(spark, sf_dir, "sparse"))
    return IO.with_names(g.select("Employee_No", "Employee_Name", "work_date", "in_duration", "out_duration"),
                         _POS_NAMES)


@register("report_csv", f"SELECT {_COERCED} FROM ({_GOLD_SPARSE})")
def report_csv(spark, sf_dir):
    """Gold report written as CSV named by its first work day, read back."""
    g = coerce_minutes_df(A.gold_attendance(silver_fixture(spark, sf_dir, "sparse")))
    path = IO.write_report(g.orderBy("Employee_No", "work_date"), work_path(spark, "reports"), "run")
    schema = T.StructType([f if f.name not in GOLD_MINUTE_COLUMNS else T.StructField(f.name, T.LongType())
                           for f in GOLD_SCHEMA.fields])
    return IO.read_csv(spark, path, schema, header=True, null_value=IO.NO_NULLS)


@register("batch_multi_file", f"""WITH raw AS ({_RAW_DIRTY}), bronze AS ({_BRONZE})
SELECT *, strftime("Swipe_Date", '%Y-%m-%d') AS landed_day FROM bronze""")
def batch_multi_file(spark, sf_dir):
    """Exports landed as one folder per day; all files cleaned in one job,
    each row keeping the day folder it came from."""
    landing = work_path(spark, "landing")
    raw = raw_dirty(spark, sf_dir).withColumn("day", F.to_date("`Swipe Date`").cast("string"))
    _csv_by_day(raw, landing)
    got = IO.read_landing(spark, landing)
    b = C.clean_bronze(got)
    return b.withColumn("landed_day", F.regexp_extract("source_file", r"day=([0-9-]+)", 1)).drop("source_file")


def _csv_by_day(raw, landing):
    IO._csv_opts(raw.write.mode("overwrite").partitionBy("day").option("quoteAll", True), True).csv(landing)


_RESENT = f"Date BETWEEN DATE '{RANGE_START}' AND DATE '{RANGE_END}'"


@register("reports_by_file", f"""WITH b1 AS ({O.bronze_batch(1)}), b2 AS ({O.bronze_batch(2)}),
b AS (SELECT * FROM b1 UNION ALL SELECT * FROM b2),
one AS ({O.dedup_from('b', cols=O.BRONZE_NAMES)}),
g AS ({O.gold_over(O.silver_cast_from('one'))}),
r AS (SELECT 'early' AS file, MIN(Date) AS a, MAX(Date) AS z FROM b1
      UNION ALL SELECT 'late', MIN(Date), MAX(Date) FROM b2
      UNION ALL SELECT 'resent', MIN(Date), MAX(Date) FROM b1 WHERE {_RESENT})
SELECT r.file, CAST(r.a AS DATE) AS first_day, {_COERCED} FROM g JOIN r ON work_date BETWEEN r.a AND r.z""")
def reports_by_file(spark, sf_dir):
    """Three exports with overlapping dates landed in one load; one CSV report
    for each, of its own date range, read back."""
    root = work_path(spark, "exports")
    r1, r2 = _batches(spark, sf_dir)
    resent = r1.where(F.to_date("`Swipe Date`").between(F.lit(RANGE_START).cast("date"), F.lit(RANGE_END).cast("date")))
    for name, rows in (("early", r1), ("late", r2), ("resent", resent)):
        IO.write_csv_quoted(rows, f"{root}/landing/{name}")
    t = B.Tables(f"{root}/bronze", f"{root}/silver", f"{root}/gold")
    res = B.run_batch(spark, IO.read_landing(spark, f"{root}/landing"), t, report_root=f"{root}/reports",
                      report_by=F.regexp_extract("source_file", "landing/([a-z]+)/", 1))
    schema = T.StructType([f if f.name not in GOLD_MINUTE_COLUMNS else T.StructField(f.name, T.LongType())
                           for f in GOLD_SCHEMA.fields])
    rows = IO.read_csv(spark, res.report, schema, header=True, null_value=IO.NO_NULLS)
    part = lambda i: F.regexp_extract("report", "([0-9]+-[0-9]+-[0-9]+)-([a-z]+)-[0-9a-f]+$", i)
    return rows.select(part(2).alias("file"), part(1).cast("date").alias("first_day"), *schema.names)


@register("stream_incremental_upsert", _gold_after_two_sql())
def stream_incremental_upsert(spark, sf_dir):
    """Two exports land one after the other; each run of the file stream
    (availableNow) upserts only the new files through bronze/silver/gold."""
    root = work_path(spark, "stream")
    t = B.Tables(f"{root}/bronze", f"{root}/silver", f"{root}/gold")
    r1, r2 = _batches(spark, sf_dir)
    for i, r in enumerate((r1, r2), 1):
        IO.write_csv_quoted(r, f"{root}/landing/export-{i}")
        ST.run_incremental(spark, f"{root}/landing", t, f"{root}/checkpoint")
    return U.read_table(spark, t.gold, GOLD_SCHEMA)


def _text_batch(spark, sf_dir):
    return FX.raw_swipes(FX.read_events(spark, sf_dir), "sparse", dirty=True, swipe_as_text=True)


@register("landing_by_header", f"""WITH raw AS ({_RAW_TEXT}), r AS (SELECT *, {_KEY} AS k FROM raw)
SELECT k AS Employee_No, {O.swipe_time('"Swipe Date"')} AS Swipe_Date, "In/Out" AS In_Out, Longitude,
       CASE WHEN "Swipe Type" LIKE 'Web%' THEN 'web-' || Status END AS Source
FROM r WHERE {_HAS_KEY} AND {_WORD_KEY} AND {O.swipe_time('"Swipe Date"')} IS NOT NULL""")
def landing_by_header(spark, sf_dir):
    """Two exports in one landing folder, one with its columns in another order
    and one column more: every column is found by its file's own header."""
    raw, landing = _text_batch(spark, sf_dir), work_path(spark, "landing")
    web = F.col("`Swipe Type`").like("Web%")
    IO.write_csv_quoted(raw.where(~web), f"{landing}/plain")
    more = raw.where(web).withColumn("Source", F.concat(F.lit("web-"), "Status"))
    IO.write_csv_quoted(more.select(*[f"`{c}`" for c in reversed(more.columns)]), f"{landing}/web")
    return C.clean_bronze(IO.read_landing(spark, landing, extra=True)).select(
        "Employee_No", "Swipe_Date", "In_Out", "Longitude", "Source")


_QUARANTINED = f"""WITH raw AS ({_RAW_TEXT}), r AS (SELECT *, {_REASON} AS why FROM raw)
SELECT 'quarantined' AS side, why AS reason, {_K} AS key_text, "Swipe Date" AS swipe_text FROM r WHERE why IS NOT NULL
UNION ALL SELECT 'kept', NULL, {_KEY}, strftime({O.swipe_time('"Swipe Date"')}, '%Y-%m-%d %H:%M:%S') FROM r WHERE why IS NULL
QUALIFY ROW_NUMBER() OVER (PARTITION BY {_KEY}, {O.swipe_time('"Swipe Date"')}) = 1"""


@register("quarantine_rows", _QUARANTINED)
def quarantine_rows(spark, sf_dir):
    """A landed export through the three tables: rows that cannot be read are
    stored with a reason, the others are in bronze."""
    root = work_path(spark, "quarantine")
    t = B.Tables(f"{root}/bronze", f"{root}/silver", f"{root}/gold")
    IO.write_csv_quoted(_text_batch(spark, sf_dir), f"{root}/landing")
    B.run_batch(spark, IO.read_landing(spark, f"{root}/landing"), t, run_id="one")
    return _both_sides(spark, t)


def _both_sides(spark, t):
    """Quarantined rows with their reason, and the keys that are in bronze."""
    row = F.from_json("row", "`Employee No` string, `Swipe Date` string")
    bad = B.read_rejects(spark, t).select(
        F.lit("quarantined").alias("side"), "reason", row["Employee No"].alias("key_text"), row["Swipe Date"].alias("swipe_text"))
    return bad.unionByName(U.read_table(spark, t.bronze).select(
        F.lit("kept").alias("side"), F.lit(None).cast("string").alias("reason"), F.col("Employee_No").alias("key_text"),
        F.col("Swipe_Date").cast("string").alias("swipe_text")))


@register("stream_two_sources_quarantine", _QUARANTINED)
def stream_two_sources_quarantine(spark, sf_dir):
    """Card and web exports land in two folders; two streams load them into one
    set of tables, and the first stream's batch comes again after a failure.
    Kept and quarantined rows are those of both exports, once."""
    root = work_path(spark, "sources")
    t = B.Tables(f"{root}/bronze", f"{root}/silver", f"{root}/gold")
    raw = _text_batch(spark, sf_dir)
    web = F.coalesce(F.col("`Swipe Type`").like("Web%"), F.lit(False))
    for name, rows in (("card", raw.where(~web)), ("web", raw.where(web))):
        IO.write_csv_quoted(rows, f"{root}/{name}")
        query, _ = ST.run_incremental(spark, f"{root}/{name}", t, f"{root}/checkpoint-{name}")
        if name == "card":
            again = IO.with_file(IO._cells(spark.read).csv(f"{root}/card"))
            ST.take_batch(again, query.id, 0, t)
    return _both_sides(spark, t)


@register("infer_declared_types", f"""WITH raw AS ({O.raw_fixture('sparse', dirty=True, keep_event=True)})
SELECT {_K} AS Employee_No, "Swipe Date" AS Swipe_Date, CAST(event_id AS BIGINT) AS Badge, "Longitude" * 2 AS Site_HQ,
       hour(ts) < 5 AS Night_Shift, date_trunc('second', ts) AS Arrived, lpad(CAST(event_id % 100 AS VARCHAR), 3, '0') AS Gate
FROM raw""")
def infer_declared_types(spark, sf_dir):
    """Columns outside the declared ones get sanitized names and a type by the
    type they come with; text stays text (gate 007)."""
    ev = FX.read_events(spark, sf_dir)
    raw = FX.raw_swipes(ev, "sparse", dirty=True, keep_event_id=True).join(ev.select("event_id", "ts", "value"), "event_id")
    raw = raw.select("`Employee No`", "`Swipe Date`", F.col("event_id").cast("int").alias("Badge #"),
                     (F.col("value") * 2).alias("Site (HQ)"), (F.hour("ts") < 5).alias("Night Shift"),
                     FN.whole_seconds(F.col("ts")).alias("Arrived"),
                     F.lpad((F.col("event_id") % 100).cast("string"), 3, "0").alias("Gate"))
    return C.typed_extras(raw, ["Employee No", "Swipe Date"])
