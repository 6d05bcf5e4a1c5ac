"""Keyed upsert with change detection on a partitioned Parquet table.

For every key in source or target:

* key only in source            -> ``insert``
* in both, any compared column differs (NULL-safe) -> ``update`` (source row wins)
* in both, nothing differs      -> ``unchanged`` (target row kept)
* key only in target            -> ``target_only`` (kept; no delete arm), or
  ``delete`` when the caller names a scope of keys the source fully owns
  (e.g. whole recomputed work days) and the key is inside it

The table keeps the union of all columns it was ever given.  A load without a
column leaves that column's values alone; lineage columns (``source_file``) are
stored but are no change by themselves.  With ``newer_by`` a source row that is
older than the stored one changes nothing, so results do not depend on the
order or the cut of loads.

For a table partitioned by a column that is a function of the key:

1. source keys are non-NULL and unique (``dedup_by`` enforces latest-wins);
2. the target is read for the partitions the source touches only (their values
   are known to the caller or collected, up to ``max_partitions``); partitions
   that the table does not have yet are not joined at all;
3. a FULL OUTER JOIN on the keys classifies every row;
4. the rows that change, and only those, are written to the load's own folder,
   each with what was done and the row it replaces; rows are sorted by key
   inside a partition, so that a reader of few keys skips row groups;
5. one rename makes them part of the table (``versions``).  Two loads at once:
   the second to finish keeps its rows if the first touched other partitions,
   and is computed again if not.  An interrupted load leaves the table as it was.

``read_table`` takes the last version of each key; partitions that only ever got
new keys are read as they are.  A partition with more than ``MAX_FOLDERS``
folders is written anew by the load that finds it (``compact``).  What a version
changed can be read as rows (``change_feed``): action, row and old row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import remove_path
from . import versions
from .versions import CHANGES, INSERTS, LOAD, Conflict, Version

ACTIONS = ("insert", "update", "unchanged", "target_only", "delete")
LINEAGE = ("source_file",)
ACTION, OLD = "_action", "_old"      # columns of the stored rows beside the table's own
MAX_FOLDERS = 16                     # loads a partition may lie in before it is written anew
TRIES = 50                           # times a load is tried again when others come first


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def align(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` in its order and types; missing ones NULL."""
    have = {f.name: f.dataType for f in df.schema.fields}
    return df.selectExpr(*[
        _q(f.name) if have.get(f.name) == f.dataType
        else f"CAST({_q(f.name) if f.name in have else 'NULL'} AS {f.dataType.simpleString()}) AS {_q(f.name)}"
        for f in schema.fields])


def merge_plan(target: DataFrame, source: DataFrame, keys: list[str],
               compare: list[str] | None = None, scope: DataFrame | None = None,
               newer_by: str | None = None, old: bool = False) -> DataFrame:
    """Rows of the table after the upsert, with an ``_action`` column and, with
    ``old``, the replaced row's columns beside the keys as ``_old``.

    Columns that the source lacks keep the target's values.  ``scope`` (distinct
    key columns, a subset of ``keys``) marks target rows the source replaces
    wholesale: those missing from the source become ``delete`` rows, which the
    writer drops.
    """
    cols, given = target.columns, set(source.columns)
    vals = [c for c in cols if c not in keys]
    compare = compare or [c for c in vals if c in given and c not in LINEAGE]

    def side(df, mark):
        return df.selectExpr(*map(_q, keys), *[f"{_q(c)} AS {_q(f'{mark}_{c}')}" for c in vals if c in df.columns],
                             f"true AS _in_{mark}")
    s, t = side(source, "s"), side(target, "t")
    if scope is not None:
        sk = scope.columns
        t = t.join(scope.select(*sk).distinct().withColumn("_in_scope", F.lit(True)), sk, "left")
    j = t.join(s, on=keys, how="full_outer")
    diff = " OR ".join(f"NOT ({_q(f't_{c}')} <=> {_q(f's_{c}')})" for c in compare) or "false"
    if newer_by:
        stored, sent = _q(f"t_{newer_by}"), _q(f"s_{newer_by}")
        diff = f"({diff}) AND coalesce({sent} >= {stored}, {stored} IS NULL)"
    gone = "_in_s IS NULL AND _in_scope IS NOT NULL" if scope is not None else "false"
    j = j.selectExpr("*", f"""CASE WHEN _in_t IS NULL THEN 'insert' WHEN {gone} THEN 'delete' WHEN _in_s IS NULL THEN 'target_only'
                              WHEN {diff} THEN 'update' ELSE 'unchanged' END AS {ACTION}""")

    def value(c):
        if c in keys:
            return _q(c)
        if c not in given:
            return f"{_q(f't_{c}')} AS {_q(c)}"
        return f"IF({ACTION} IN ('insert', 'update'), {_q(f's_{c}')}, {_q(f't_{c}')}) AS {_q(c)}"
    was = ", ".join(f"'{c}', {_q(f't_{c}')}" for c in vals)
    return j.selectExpr(*map(value, cols), ACTION, *([f"IF(_in_t, named_struct({was}), NULL) AS {OLD}"] if old else []))


def action_counts(merged: DataFrame) -> DataFrame:
    """One row: how many keys fall in each class (M4)."""
    return merged.agg(*[F.count_if(F.col("_action") == a).alias(a) for a in ACTIONS])


def dedup_by(df: DataFrame, keys: list[str], latest: str | None) -> DataFrame:
    """One row per key: the latest by ``latest``; the whole row breaks ties,
    lineage last.  The row is its own order (``max`` of one struct), reduced
    map-side."""
    rest = [c for c in df.columns if c not in keys]
    rest.sort(key=lambda c: (c != latest, c in LINEAGE))
    picked = df.groupBy(*keys).agg(F.max(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("_r"))
    return picked.select(*keys, "_r.*").select(*[f"`{c}`" for c in df.columns])


@dataclass
class UpsertResult:
    path: str
    counts: dict
    partitions_written: list
    version: int = 0
    repeated: bool = False       # the load was in already


# ---- reading
def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a load, or plain Parquet files, made a table here."""
    if versions.numbers(spark, path.rstrip("/")):
        return True
    # a plain table: any partition folder or data file
    return any(not n.startswith(("_", ".")) for n in versions.names(spark, path))


def table_schema(spark: SparkSession, path: str) -> T.StructType | None:
    """All columns of a table, or None if no upsert made it."""
    return versions.current(spark, path).struct() or None


def _scan(spark: SparkSession, path: str, folders: list[str], schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("basePath", path).parquet(*[f"{path}/{f}" for f in folders])


def _rows(spark: SparkSession, path: str, v: Version, parts: list[str]) -> DataFrame:
    """The rows of the partitions ``parts`` (values as text) in version ``v``."""
    full, col = v.struct(), v.partition_col
    names = [f"`{f.name}`" for f in full.fields]
    stored = T.StructType([*full.fields, T.StructField(ACTION, T.StringType())])

    def scan(pairs: list[tuple[str, str]]) -> DataFrame:
        """Rows of (load, partition) folders; the files of a plain table have no load."""
        own = [f"{LOAD}={load}/{versions.partition_folder(spark, col, p)}" for load, p in pairs if load]
        plain = [versions.partition_folder(spark, col, p) for load, p in pairs if not load]
        found = [_scan(spark, path, own, stored).select(*names, ACTION, LOAD)] if own else []
        if plain:
            found.append(_scan(spark, path, plain, full).select(
                *names, F.lit(None).cast("string").alias(ACTION), F.lit("").alias(LOAD)))
        return reduce(DataFrame.unionByName, found)
    settled, first, later = [], [], []
    for p in parts:
        loads = v.parts.get(p, [])
        if all(kind == INSERTS for _, kind in loads):        # every key once
            settled += [(load, p) for load, _ in loads]
        else:
            first.append((loads[0][0], p))
            later += [(load, p) for load, _ in loads[1:]]
    out = [scan(settled).select(*names)] if settled else []
    if later:
        # the last row of each changed key, and the older rows of all other keys
        keys = list(v.keys)
        last = scan(later).groupBy(*keys).agg(
            F.max_by(F.struct(*[n for n, f in zip(names, full.fields) if f.name not in keys], ACTION), F.col(LOAD)).alias("_r"))
        last = last.select(*keys, "_r.*")
        out.append(scan(first).join(last.select(*keys), keys, "left_anti").select(*names))
        out.append(last.where(F.col(ACTION) != "delete").select(*names))
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], full)


def _adopted(spark: SparkSession, path: str, keys: list[str], partition_col: str) -> Version:
    """The current version, or one that names the files of a plain table."""
    v = versions.current(spark, path)
    if v.number or not table_exists(spark, path):
        return v
    schema = spark.read.parquet(path).schema
    values = [str(r[0]) for r in spark.read.parquet(path).select(partition_col).distinct().collect()]
    return Version(0, schema.jsonValue(), tuple(keys), partition_col, {p: [["", INSERTS]] for p in values})


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, partitions: list | None = None,
               version: int | None = None, between: tuple[str, str] | None = None) -> DataFrame:
    """The table as of now (or of ``version``), with ``schema`` or else all its
    columns.  ``partitions`` limits what is listed and read to these values,
    ``between`` to values whose texts are in that range (days)."""
    path = path.rstrip("/")
    v = versions.current(spark, path) if version is None else versions.at(spark, path, version)
    if not v.number:             # plain Parquet files: the caller's filter prunes them
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    parts = list(v.parts) if partitions is None else [p for p in map(str, partitions) if p in v.parts]
    if between:
        parts = [p for p in parts if between[0] <= p <= between[1]]
    df = _rows(spark, path, v, parts)
    return align(df, schema) if schema else df


def change_feed(spark: SparkSession, path: str, after: int = 0, upto: int | None = None) -> DataFrame:
    """What the versions in (after, upto] did: the table's columns (of a deleted
    row its last values), ``_action``, ``_old`` (the replaced row's columns
    beside the keys) and ``_load``, whose order is that of the versions."""
    path = path.rstrip("/")
    v = versions.current(spark, path)
    told = versions.feeds(spark, path, after, v.number if upto is None else upto)
    full = v.struct()
    old = T.StructType([f for f in full.fields if f.name not in v.keys])
    stored = T.StructType([*full.fields, T.StructField(ACTION, T.StringType()), T.StructField(OLD, old)])
    names = [f"`{f.name}`" for f in full.fields]
    folders = [f"{LOAD}={f['load']}/{versions.partition_folder(spark, v.partition_col, p)}" for f in told for p in f["parts"]]
    if not folders:
        return spark.createDataFrame([], T.StructType([*stored.fields, T.StructField(LOAD, T.StringType())]))
    return _scan(spark, path, folders, stored).select(*names, ACTION, OLD, LOAD)


def fed_partitions(spark: SparkSession, path: str, after: int, upto: int) -> list[str]:
    """Values of the partitions that the versions in (after, upto] changed."""
    return sorted({p for f in versions.feeds(spark, path.rstrip("/"), after, upto) for p in f["parts"]})


def partition_values(df: DataFrame, partition_col: str, most: int) -> list:
    """Distinct partition values (days), at most ``most`` of them."""
    values = [r[0] for r in df.select(partition_col).distinct().limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"more than {most} values of {partition_col}; load fewer at once or raise max_partitions")
    return sorted(values)


# ---- writing
def _write(rows: DataFrame, path: str, load: str, partition_col: str, keys: list[str]) -> None:
    """Rows to the folder of a load: AQE sizes the files and splits a skewed
    partition value; files are sorted by key inside a partition value."""
    rows.hint("rebalance", partition_col).sortWithinPartitions(partition_col, *[k for k in keys if k != partition_col]) \
        .write.mode("overwrite").partitionBy(partition_col).parquet(f"{path}/{LOAD}={load}")


def observed(obs: Observation) -> dict:
    """What was observed; nothing where Spark found the input empty and left the observed step out."""
    return obs.get if obs._jo.getRow().size() else {}


def upsert(spark: SparkSession, path: str, source: DataFrame, keys: list[str], partition_col: str,
           schema: T.StructType | None = None, compare: list[str] | None = None,
           latest: str | None = None, partitions: list | None = None,
           unique_keys: bool = False, scope: DataFrame | None = None,
           newer_by: str | None = None, max_partitions: int = 100_000, commit: bool = True,
           load: tuple[str, int] | None = None, took: int | None = None, rejects: str | None = None,
           base: Version | None = None) -> UpsertResult:
    """Upsert ``source`` into the Parquet table at ``path`` (created if missing).

    ``partitions``: the partition values that source and scope hold, if the
    caller knows them; else they are collected.  ``unique_keys`` skips the
    latest-wins reduction for a source with one row per key by construction.
    ``scope``, ``newer_by``: see ``merge_plan``.  ``load`` (stream, batch): this
    load is in the table once; if that batch, or a later one of the stream, is in
    already, nothing is done.  ``took``, ``rejects``: kept with the version, see
    ``versions``.  ``commit=False`` stops with the rows written (for tests of
    interruptions).  A load that others overtake is computed again, or raises
    ``Conflict`` if the caller says with ``base`` what it was derived for.
    """
    path = path.rstrip("/")
    for _ in range(1 if base else TRIES):
        v = base or _adopted(spark, path, keys, partition_col)
        if v.has(load):
            return UpsertResult(path, dict.fromkeys(ACTIONS, 0), [], v.number, True)
        try:
            return _upsert(spark, path, v, source, keys, partition_col, schema, compare, latest, partitions, unique_keys,
                           scope, newer_by, max_partitions, commit, load, took, rejects)
        except Conflict:
            if base:
                raise
    raise RuntimeError(f"{path}: {TRIES} other loads came first")


def _upsert(spark, path, v, source, keys, partition_col, schema, compare, latest, partitions, unique_keys, scope,
            newer_by, max_partitions, commit, load, took, rejects) -> UpsertResult:
    declared = schema or source.schema
    stored = v.struct()
    full = T.StructType([*stored.fields, *[f for f in declared.fields if f.name not in stored.fieldNames()]])
    given = T.StructType([f for f in full.fields if f.name in source.columns])
    src = align(source.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])), given)
    touched = src.select(partition_col)   # a function of the key: the reduction below cannot change the set
    if not unique_keys:
        src = dedup_by(src, keys, latest)
    if partitions is None and v.parts:
        if scope is not None and partition_col in scope.columns:
            touched = touched.unionByName(scope.select(partition_col))
        partitions = partition_values(touched, partition_col, max_partitions)
    known = [str(p) for p in partitions or [] if str(p) in v.parts]
    if known:
        target = align(_rows(spark, path, v, known), full)
        every = merge_plan(target, src, keys, compare, scope, newer_by, old=True)
    else:                                  # nothing to compare with
        old = T.StructType([f for f in full.fields if f.name not in keys])
        every = align(src, full).withColumns({ACTION: F.lit("insert"), OLD: F.lit(None).cast(old)})
    # counts and changed partitions, gathered while the changed rows are
    # written; the sets hold partition values that ``partitions`` bounds
    obs, value, action = Observation("upsert"), F.col(partition_col), F.col(ACTION)
    new = action.isin("insert", "update", "delete")
    rows = every.observe(
        obs, *[F.count_if(action == a).alias(a) for a in ACTIONS],
        F.collect_set(F.when(new, value)).alias("_dirty"),
        F.collect_set(F.when(action.isin("update", "delete"), value)).alias("_changed")).where(new)
    name = versions.new_load(v)
    _write(rows, path, name, partition_col, keys)
    m = observed(obs)
    if not m and known:                    # nothing to write: Spark left the observed step out
        m = {r[ACTION]: r["count"] for r in every.groupBy(ACTION).count().collect()}
    counts = {a: int(m.get(a, 0)) for a in ACTIONS}
    dirty, again = sorted(m.get("_dirty", [])), {str(d) for d in m.get("_changed", [])}
    if not commit:
        return UpsertResult(path, counts, dirty, v.number)
    if not dirty:
        remove_path(spark, f"{path}/{LOAD}={name}")
    texts = [str(d) for d in dirty]
    now = v
    while True:
        changes = {"schema": full.jsonValue(), "keys": tuple(keys), "partition_col": partition_col}
        if dirty:
            changes |= {"parts": now.parts | {p: [*now.parts.get(p, []), [name, CHANGES if p in again else INSERTS]] for p in texts},
                        "feed": {"load": name, "parts": texts}}
        if load:
            changes["loads"] = now.loads | {load[0]: load[1]}
        if took is not None:
            changes["took"] = max(took, now.took)
        if rejects:
            changes["rejects"] = [*now.rejects, rejects]
        quiet = not dirty and not load and not rejects and changes.get("took", now.took) == now.took
        if quiet and now.number and full == stored:
            return UpsertResult(path, counts, dirty, now.number)       # nothing new: no version
        try:
            done = versions.commit(spark, path, now, **changes)
            break
        except Conflict:
            newer = versions.current(spark, path)
            # others came first: the rows stand if nobody touched what they were compared with
            meant = {*texts, *map(str, partitions or [])}
            if newer.has(load) or newer.took != now.took or newer.struct() != stored or newer.differs(v) & meant \
                    or (partitions is None and newer.parts):
                if dirty:
                    remove_path(spark, f"{path}/{LOAD}={name}")        # its own rows, which no version names
                raise
            now = newer
    crowded = [p for p in texts if len(done.parts[p]) > MAX_FOLDERS]
    if crowded:
        compact(spark, path, crowded)
    return UpsertResult(path, counts, dirty, done.number)


def compact(spark: SparkSession, path: str, partitions: list | None = None) -> int:
    """Write the partitions (default: all that lie in several folders) anew as one folder, rows
    in ranges of the key; returns how many.  What was changed stays readable in
    the old folders until ``versions.vacuum``.  Left undone if a load came first."""
    path = path.rstrip("/")
    v = versions.current(spark, path)
    parts = [p for p in (v.parts if partitions is None else map(str, partitions)) if len(v.parts.get(p, [])) > 1]
    if not parts:
        return 0
    name = versions.new_load(v)
    rows = _rows(spark, path, v, parts)
    by = [v.partition_col, *[k for k in v.keys if k != v.partition_col]]
    obs = Observation("compact")
    rows.withColumn(ACTION, F.lit(None).cast("string")) \
        .observe(obs, F.collect_set(F.col(v.partition_col)).alias("parts")).repartitionByRange(*by).sortWithinPartitions(*by) \
        .write.mode("overwrite").partitionBy(v.partition_col).parquet(f"{path}/{LOAD}={name}")
    left = {str(p) for p in observed(obs).get("parts", [])}
    moved = {p: [[name, INSERTS]] for p in parts if p in left}
    try:
        versions.commit(spark, path, v, parts={p: x for p, x in v.parts.items() if p not in parts} | moved)
    except Conflict:
        remove_path(spark, f"{path}/{LOAD}={name}")
        return 0
    return len(parts)
