"""Raw swipe export -> cleaned bronze rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import sanitize_name, strip, time_text
from ..schemas import NO_HEADER, RENAME_MAP

KEY_RAW = "Employee No"
SWIPE_RAW = "Swipe Date"


# --- fixed values: texts that read as missing, and the date-time texts accepted ---
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
           "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
SWIPE_FORMATS = ["dd-MMM-yyyy HH:mm:ss", "dd-MMM-yyyy HH:mm", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm"]
# --- end of fixed values ---


def key_present(raw: DataFrame, key: str = KEY_RAW) -> Column:
    """Whether a row has a key: not NULL and no missing-value text."""
    c = F.col(f"`{key}`")
    if isinstance(raw.schema[key].dataType, T.StringType):
        return c.isNotNull() & ~strip(c).isin(MISSING)
    return c.isNotNull()


def drop_missing_key(raw: DataFrame, key: str = KEY_RAW) -> DataFrame:
    """Rows whose employee number is missing are dropped."""
    return raw.where(key_present(raw, key))


def key_text(raw: DataFrame, key: str = KEY_RAW) -> Column:
    """Employee number as text without white space at its ends; a whole number
    held as a float or decimal has no fraction and no exponent."""
    c = F.col(f"`{key}`")
    if isinstance(raw.schema[key].dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
        whole = c.cast("double") == F.floor(c.cast("double"))
        return F.when(whole, c.try_cast("decimal(38,0)").cast("string")).otherwise(c.cast("string"))
    return strip(c.cast("string"))


def cast_trim(raw: DataFrame, key: str = KEY_RAW) -> DataFrame:
    """The key replaced by its text (``key_text``)."""
    return raw.withColumn(key, key_text(raw, key))


def keep_word_keys(raw: DataFrame, key: str = KEY_RAW) -> DataFrame:
    """Keep rows whose key has at least one letter or digit."""
    return raw.where(F.col(f"`{key}`").rlike("[a-zA-Z0-9]"))


def parse_swipe(raw: DataFrame, col: str = SWIPE_RAW) -> DataFrame:
    """``Swipe Date`` as timestamp_ntz.  Text may be ISO or one of
    ``SWIPE_FORMATS`` (month first where both are numbers); anything else
    becomes NULL, kept for the quarantine instead of failing the job."""
    dt = raw.schema[col].dataType
    c = F.col(f"`{col}`")
    if isinstance(dt, T.TimestampNTZType):
        return raw
    if isinstance(dt, T.TimestampType):
        return raw.withColumn(col, c.cast("timestamp_ntz"))
    text = strip(c.cast("string"))
    named = [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in SWIPE_FORMATS]
    return raw.withColumn(col, F.coalesce(text.try_cast("timestamp_ntz"), *named))


def with_date_parts(df: DataFrame, col: str = SWIPE_RAW) -> DataFrame:
    """Date, time (HH:mm:ss), Year, Day, Month_short_name, Month_Number."""
    ts = F.col(f"`{col}`")
    d = F.to_date(ts)
    return df.withColumns({
        "Date": d,
        "time": time_text(ts),
        "Year": F.year(d),
        "Day": F.dayofmonth(d),
        "Month_short_name": F.date_format(d, "MMM"),
        "Month_Number": F.month(d),
    })


def table_names(columns: list[str]) -> dict[str, str]:
    """Header -> table column name: the fixed map, else the sanitizer rule.

    Two headers landing on one name would silently merge columns, so that
    is an error naming both.
    """
    out: dict[str, str] = {}
    seen: dict[str, str] = {}
    for c in columns:
        n = RENAME_MAP.get(c, sanitize_name(c))
        n = sanitize_name(n)
        if n in seen:
            raise ValueError(f"columns {seen[n]!r} and {c!r} both map to {n!r}")
        seen[n] = c
        out[c] = n
    return out


def rename_columns(df: DataFrame) -> DataFrame:
    m = {k: v for k, v in table_names(df.columns).items() if k != v}
    return df.withColumnsRenamed(m) if m else df


def removal_reason(raw: DataFrame, key: str = KEY_RAW, swipe: str = SWIPE_RAW) -> Column:
    """Why a row (its swipe time parsed) is removed; NULL if it stays."""
    return (F.when(~key_present(raw, key), "null_key")
            .when(~key_text(raw, key).rlike("[a-zA-Z0-9]"), "no_word_key")
            .when(F.col(f"`{swipe}`").isNull(), "bad_swipe_date"))


def cleaning_counts(raw: DataFrame, key: str = KEY_RAW, swipe: str = SWIPE_RAW) -> DataFrame:
    """One-row report of why rows are removed, in one pass (no second scan)."""
    why = removal_reason(raw, key, swipe)
    return raw.agg(
        F.count(F.lit(1)).alias("initial_rows"),
        *[F.count_if(why == r).alias(r) for r in ("null_key", "no_word_key", "bad_swipe_date")],
        F.count_if(why.isNull()).alias("final_rows"),
    ).withColumn("removed_rows", F.col("initial_rows") - F.col("final_rows"))


def classified(raw: DataFrame) -> DataFrame:
    """Bronze rows (18 renamed columns, 6 date parts, any others) of all raw
    rows, with ``_reason`` (NULL: the row stays) and, for rows that do not stay,
    ``_raw``: the row as it came, as JSON.  Landed rows of files without a
    header do not stay (``no_header``, with their cells)."""
    columns = [c for c in raw.columns if c != NO_HEADER]
    cells = F.col(NO_HEADER) if NO_HEADER in raw.columns else F.lit(None).cast("string")
    given = F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"})
    df = parse_swipe(raw.withColumn("_raw", F.coalesce(cells, given)))
    df = df.withColumn("_reason", F.when(cells.isNotNull(), "no_header").otherwise(removal_reason(df))).withColumn(
        "_raw", F.when(F.col("_reason").isNotNull(), F.col("_raw")))
    names = table_names(columns)
    df = with_date_parts(cast_trim(df))
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()],
                     "Date", "time", "Year", "Day", "Month_short_name", "Month_Number", "_reason", "_raw")


def clean_bronze(raw: DataFrame, quarantine: bool = False):
    """Raw export -> bronze.  With ``quarantine=True`` also the rows that are
    not in it, as (reason, row)."""
    df = classified(raw)
    good = df.where(F.col("_reason").isNull()).drop("_reason", "_raw")
    if not quarantine:
        return good
    lineage = [c for c in ("source_file",) if c in raw.columns]
    return good, df.where(F.col("_reason").isNotNull()).select(
        *lineage, F.col("_reason").alias("reason"), F.col("_raw").alias("row"))


def declared_type(kind: T.DataType) -> str:
    """Table type of a column that the table does not declare, by the type it
    comes with; text stays text."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "bigint"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "double"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    return "timestamp_ntz" if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else "string"


def typed_extras(df: DataFrame, declared: list[str]) -> DataFrame:
    """``df`` with columns renamed by the table rule and those outside
    ``declared`` cast to their ``declared_type``."""
    names = table_names(df.columns)
    return df.select(*[
        (F.col(f"`{c}`") if c in declared else F.col(f"`{c}`").cast(declared_type(df.schema[c].dataType))).alias(n)
        for c, n in names.items()])
