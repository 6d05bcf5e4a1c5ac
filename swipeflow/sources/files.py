"""File sources and sinks: CSV in and out, Parquet tables, report folders.

Timestamps in CSV use ``yyyy-MM-dd HH:mm:ss`` both ways, and the double
quote escapes itself (``escape='"'``): with the default backslash escape an
embedded quote or a trailing backslash would shift columns on read.
Leading/trailing blanks are kept on write (Spark trims them by default),
and NULL is written as ``\\N`` so that it survives next to the empty string
(with every field quoted both would otherwise read back the same).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import sanitize_name, strip
from ..schemas import BRONZE_SCHEMA, NO_HEADER, RAW_SCHEMA
from ..session import materialize

TS_FORMAT = "yyyy-MM-dd HH:mm:ss"
NULL_MARK = "\\N"
# read-side NULL marker for files whose NULLs are empty cells (reports):
# a control character that never appears, so "" reads back as ""
NO_NULLS = "\u0001"
RESCUED, LOADED = "_rescued", "_loaded"    # columns of appended tables: unreadable cells; file and its time


def _csv_opts(w, header: bool, null_value: str = NULL_MARK):
    # emptyValue keeps its defaults: written as a quoted "", read back as ""
    return (w.option("header", header).option("escape", '"').option("quote", '"')
            .option("nullValue", null_value)
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
            .option("timestampNTZFormat", TS_FORMAT).option("timestampFormat", TS_FORMAT)
            .option("dateFormat", "yyyy-MM-dd"))


def write_csv_quoted(df: DataFrame, path: str, header: bool = True, encoding: str = "utf-8",
                     mode: str = "overwrite", null_value: str = NULL_MARK) -> str:
    """CSV with every field quoted (one file per task, no gathering)."""
    w = df.write.mode(mode).option("quoteAll", True).option("encoding", encoding)
    _csv_opts(w, header, null_value).csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             header: bool = False, multiline: bool = False, null_value: str = NULL_MARK) -> DataFrame:
    """CSV with an explicit schema (no inference pass over the data).  Line breaks
    inside fields need ``multiline``, which makes each file one task."""
    r = _csv_opts(spark.read, header, null_value).option("multiLine", multiline)
    if schema is not None:
        r = r.schema(schema)
    return r.csv(path)


def load_csv_append(spark: SparkSession, csv_path: str, table_path: str,
                    types: dict[str, str] | None = None, force: bool = True) -> DataFrame:
    """Headered CSV appended to a Parquet table, cast to the table's types; new
    columns take their type from ``types``, else text.  A later read with
    ``mergeSchema`` unions the columns of all loads.

    A cell that does not read as its type becomes NULL and stays as text in
    RESCUED, a JSON object by column (NULL if all cells read).  LOADED names the
    file and the time it was last changed.  Every load is appended again, seen or
    not; with ``force=False`` rows of files that the table has are left out, by
    the rows' own LOADED, so the list of files is always that of the rows."""
    from ..operators.upsert import table_exists
    known = read_merged(spark, table_path) if table_exists(spark, table_path) else None
    have = {f.name: f.dataType.simpleString() for f in known.schema} if known else {}
    kinds = (types or {}) | have
    df = read_csv(spark, csv_path, header=True)
    cells = df.columns
    df = df.withColumn(LOADED, F.concat_ws("@", "_metadata.file_path", "_metadata.file_modification_time"))
    if not force and LOADED in have:
        # one row per file on the right; Spark broadcasts it where it is small
        df = df.join(known.select(LOADED).where(F.col(LOADED).isNotNull()).distinct(), LOADED, "left_anti")
    typed = {c: F.col(f"`{c}`").try_cast(kinds[c]) for c in cells if c in kinds}
    lost = {c: F.when(F.col(f"`{c}`").isNotNull() & t.isNull(), F.col(f"`{c}`")) for c, t in typed.items()}
    if lost:
        any_lost = F.coalesce(*lost.values()).isNotNull()
        rescued = F.when(any_lost, F.to_json(F.struct(*[v.alias(c) for c, v in lost.items()])))
    else:
        rescued = F.lit(None).cast("string")
    out = df.select(*[typed.get(c, F.col(f"`{c}`")).alias(c) for c in cells], rescued.alias(RESCUED), LOADED)
    out.write.mode("append").parquet(table_path)
    return out


def read_merged(spark: SparkSession, table_path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(table_path)


def create_if_missing(df: DataFrame, path: str, partition_col: str | None = None) -> None:
    """Write ``df`` as a new table only when nothing is at ``path`` yet."""
    w = df.write.mode("ignore")
    if partition_col:
        w = w.partitionBy(partition_col)
    w.parquet(path)


def with_names(df: DataFrame, names: list[str]) -> DataFrame:
    """Positional names: pad with ``col_i`` or cut to the row width."""
    n = len(df.columns)
    names = list(names)[:n] + [f"col_{i}" for i in range(len(names), n)]
    return df.toDF(*names)


def write_report(report: DataFrame, root: str, run_id: str, first=None, date_col: str = "work_date") -> str:
    """CSV report folder ``<root>/<run_id>/attendance_report_<first day>``.

    ``first`` is the first day if the caller knows it; else the report is staged
    and its first day read from there (today's date for an empty one), so it is
    computed once.  The run id keeps two reports with the same first day apart.
    Rows stay distributed (one file per task, files in sort order); no
    byte-order mark is written.
    """
    import datetime as _dt
    if first is None and date_col in report.columns:
        report = materialize(report)
        first = report.agg(F.min(date_col)).first()[0]
    path = f"{root.rstrip('/')}/{run_id}/attendance_report_{(first or _dt.date.today()).strftime('%Y-%m-%d')}"
    _csv_opts(report.write.mode("overwrite"), True, "").csv(path)
    return path


def write_file_reports(gold: DataFrame, files: DataFrame, root: str, run_id: str, date_col: str = "work_date") -> DataFrame:
    """One report per file, all in one job.  ``files`` (source_file, first, last):
    the range of days each file's report covers; ranges may overlap.  Each
    file's days are listed and joined to the gold rows by day; the rows are
    written as CSV to ``<root>/<run_id>/report=attendance_report_<first day>-<file>``,
    in order of employee and day.  Returns (source_file, first, last, report)."""
    name = F.regexp_replace(F.element_at(F.split("source_file", "/"), -1), r"\.[^.]*$", "")
    # files of one name in two folders keep apart
    report = F.concat(F.lit("attendance_report_"), F.col("first").cast("string"), F.lit("-"), name, F.lit("-"),
                      F.substring(F.sha2("source_file", 256), 1, 8))
    files = files.withColumn("report", report)
    days = files.select("report", F.explode(F.sequence("first", "last")).alias(date_col))
    rows = gold.join(days, date_col).select("report", *[f"`{c}`" for c in gold.columns])
    by = ["report", "Employee_No", date_col]
    w = rows.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").partitionBy("report")
    _csv_opts(w, True, "").csv(f"{root.rstrip('/')}/{run_id}")
    return files


MAX_COLUMNS = 63         # widest export that is read; a wider one is an error


def _cells(reader) -> object:
    """Reader of CSV rows as text cells, whatever their headers.  One declared column
    more than is ever read: Spark then has the parser pick columns by position, and
    cells that a row lacks come as NULL; with all of them read, each lacking cell
    and each row would be an exception caught inside the parser."""
    schema = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(MAX_COLUMNS + 2)])
    return (reader.schema(schema).option("header", False).option("escape", '"').option("quote", '"')
            .option("nullValue", NULL_MARK).option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False).option("recursiveFileLookup", True))


def with_file(cells: DataFrame) -> DataFrame:
    """(source_file, cells) of rows read by ``_cells``."""
    too_wide = F.raise_error(F.lit(f"an export has more than {MAX_COLUMNS} columns")).cast("string")
    last = F.when(F.col(f"_{MAX_COLUMNS}").isNotNull(), too_wide).otherwise(F.col(f"_{MAX_COLUMNS - 1}"))
    return cells.select(F.col("_metadata.file_path").alias("source_file"),
                        F.array(*[f"_{i}" for i in range(MAX_COLUMNS - 1)], last).alias("cells"))


def _norm(name: Column) -> Column:
    """A header name as it is matched: without blanks at its ends, in lower case."""
    return F.lower(strip(name))


def _is_header(key: str) -> Column:
    """Whether a cell is ``key``.  The row's text is searched first: cells are only
    looked at one by one where it holds the key."""
    holds = F.lower(F.array_join("cells", "\n")).contains(key.strip().lower())
    return holds & F.coalesce(F.exists("cells", lambda c: _norm(c) == F.lit(key.lower())), F.lit(False))


def by_header(rows: DataFrame, key: str = "Employee No", extra: tuple | None = None) -> DataFrame:
    """Rows of files that each carry their own header, columns found by name.

    A row that holds ``key`` as a cell (blanks at its ends and case aside) is its
    file's header, the one with most declared names if there are several; the
    headers (one row per file) are joined to the rows by file.  Result: the
    declared export columns as text, typed where the schema says number, dates
    kept as text for the cleaner, the ``extra`` columns (default: all headers
    beyond the declared) as text, the file name, and NO_HEADER: the cells, as
    JSON, of rows whose file has no header (else NULL).  Columns a file lacks are
    NULL."""
    known = F.array(*[F.lit(f.name.lower()) for f in RAW_SCHEMA.fields])
    names = F.transform("cells", lambda c: F.coalesce(_norm(c), F.lit("")))
    heads = rows.where(_is_header(key)).groupBy("source_file").agg(
        F.max(F.struct(F.size(F.array_intersect(names, known)).alias("n"), F.col("cells"), names.alias("names"))).alias("h"))
    heads = materialize(heads.select("source_file", F.col("h.cells").alias("head"), F.col("h.names").alias("names")))
    extra = tuple(headers(heads)) if extra is None else extra
    # where each column stands is found once per file; a column it lacks is at -1, outside any row
    place = {c: f"_at_{i}" for i, c in enumerate((*RAW_SCHEMA.fieldNames(), *extra))}
    heads = heads.select("source_file", "head", *[
        (F.array_position("names", F.lit(c.strip().lower())) - 1).cast("int").alias(at) for c, at in place.items()])
    body = rows.join(heads, "source_file", "left").where(~F.col("cells").eqNullSafe(F.col("head")))

    def cell(name):
        return F.get("cells", F.col(place[name]))
    number = (T.DoubleType,)
    cols = [(cell(f.name).try_cast(f.dataType) if isinstance(f.dataType, number) or f.name == "Received On" else cell(f.name))
            .alias(f.name) for f in RAW_SCHEMA.fields]
    filled = F.slice("cells", 1, F.greatest(F.lit(1), F.array_max(F.transform(
        "cells", lambda c, i: F.when(c.isNotNull(), i + 1).otherwise(0)))))
    no_header = F.when(F.col("head").isNull(), F.to_json(F.struct(filled.alias("cells")), {"ignoreNullFields": "false"}))
    return body.select(*cols, *[cell(c).alias(n) for c, n in _free_names(extra).items()], "source_file",
                       no_header.alias(NO_HEADER))


def _free_names(extra: tuple) -> dict[str, str]:
    """Undeclared headers -> names that meet no declared or other column."""
    taken = {n.lower() for n in (*RAW_SCHEMA.fieldNames(), *BRONZE_SCHEMA.fieldNames(), "source_file", NO_HEADER)}
    out = {}
    for c in extra:
        n = c.replace("`", "'")
        while sanitize_name(n).lower() in taken:
            n += "_2"
        taken.add(sanitize_name(n).lower())
        out[c] = n
    return out


def headers(heads: DataFrame) -> list[str]:
    """Header names beyond the declared ones, one spelling each (bounded by
    MAX_COLUMNS times the number of distinct headers)."""
    named = heads.select(F.explode("head").alias("c")).select(strip(F.col("c")).alias("name"))
    named = named.where("name <> ''").groupBy(_norm(F.col("name")).alias("n")).agg(F.min("name").alias("name"))
    declared = {f.name.lower() for f in RAW_SCHEMA.fields}
    return sorted(r["name"] for r in named.collect() if r["n"] not in declared)


def read_landing(spark: SparkSession, path: str, extra: bool = True) -> DataFrame:
    """Every CSV file under a landing folder in one read, columns found by each
    file's own header, with its file name; ``extra`` keeps undeclared columns."""
    rows = with_file(_cells(spark.read).csv(path))
    return by_header(rows, extra=None if extra else ())
