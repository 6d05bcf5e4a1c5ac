"""Helpers shared by the text operators: shared-folder staging, words, names, components.

Staged tables live under the folder that ``spark.checkpoint.dir`` names, so a
lost executor loses nothing: the files are on storage that every node reads.
"""

from __future__ import annotations

import sys
import types

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import work_path

# --- fixed values -----------------------------------------------------------
WORD = r"[^\x20\x09-\x0D]+"     # a word, as the contracts define it
GAP = r"[\x20\x09-\x0D]+"       # what stands between words
# ----------------------------------------------------------------------------
BITS = 1 << 23                  # bits of a document bitmap: one megabyte
LAST = (1 << 63) - 1            # where null ids stand in the order of ids


def by_value(module: str) -> None:
    """Ship a module's functions to Python workers by value, so that executors
    need the public libraries but not this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


by_value(__name__)


def per_process(key, build):
    """``build()`` once per Python worker process; later tasks find it again."""
    store = sys.modules.setdefault("_llm_per_process", types.ModuleType("_llm_per_process")).__dict__
    if key not in store:
        store[key] = build()
    return store[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new folder under the shared folder and read it back:
    cuts lineage and is not recomputed."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstage(*frames: DataFrame) -> None:
    """Delete staged copies that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        jvm = spark._jvm
        for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names near ``names`` that no column of ``df`` has (case ignored)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def col(df: DataFrame, name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return df["`" + name.replace("`", "``") + "`"]


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.filter(F.split(text_of(text), GAP), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words, without keeping them: gaps between words, plus one."""
    t = F.regexp_replace(text_of(text), f"^{GAP}|{GAP}$", "")
    return F.when(t == "", 0).otherwise(F.regexp_count(t, F.lit(GAP)) + 1).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.  A column named
    inside a lambda would otherwise be computed again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def split_by_bitmap(docs: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` split into those whose ``key`` (never null) may be among the
    values of the one column of ``ids``, and those whose key is not.  The bitmap
    has BITS bits whatever the input; where it is crowded, more documents are
    named, and none is lost."""
    def bit(c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(BITS)) + 1
    bucket, bits, named = fresh(docs, "bucket", "bits", "named")
    maps = ids.select(bit(F.col(ids.columns[0])).alias("v")).groupBy(F.bitmap_bucket_number("v").alias(bucket)).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias(bits))
    maps = stage(maps, "bitmap")
    at = F.bitmap_bit_position(bit(col(docs, key)))
    byte = F.conv(F.hex(F.substr(F.col(bits), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = (docs.withColumn(bucket, F.bitmap_bucket_number(bit(col(docs, key))))
              .join(F.broadcast(maps), bucket, "left")       # at most BITS / 32768 rows of 4 KB
              .withColumn(named, F.coalesce(
                  F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(1) == 1, F.lit(False)))
              .drop(bucket, bits))
    return marked.where(F.col(named)).drop(named), marked.where(~F.col(named)).drop(named)


def prefix_sum(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Exclusive running sum of ``value`` over all rows in ``order``, without a
    single-task window: range partitions, one total per partition (their number
    is bounded by the partition count), running sums inside each.

    ``order`` must be unique, so that no key is hot.
    """
    part, base = "__part", "__base"
    parts = stage(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")
    totals = parts.groupBy(part).agg(F.sum(value).alias(base)).orderBy(part).collect()
    run, offsets = 0, []
    for r in totals:
        offsets.append((r[part], run))
        run += r[base] or 0
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # as an Arrow table: rows of Python objects would start Python workers on the executors to read them
    offs = df.sparkSession.createDataFrame(pa.table({
        part: pa.array([p for p, _ in offsets], pa.int32()), base: pa.array([b for _, b in offsets], pa.int64())}))
    return (parts.join(F.broadcast(offs), part)
            .withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)) + F.col(base))
            .drop(part, base))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``links(a, b)`` (a != b) -> ``(node, root)``
    with ``root`` the smallest node reached; only linked nodes are returned.

    Alternating large-star and small-star steps.  Each step is one minimum per
    node (partially aggregated) and one join, so a node with a third of all
    links is split by the skew join, and no component is ever gathered.  Every
    round is staged in the shared folder.  Stops when a round changes nothing.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = stage(links.select(low.alias("a"), high.alias("b")).where("a < b").distinct(), "links")
    mark = None
    for _ in range(rounds):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # minima are staged, so that both sides of the join are plain exchanges, which skew joins can split
        least = stage(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = (both.where("b > a").join(least, "a")
                 .select(F.col("m").alias("a"), "b").where("a < b").distinct())
        large = stage(large, "large")
        unstage(least)
        # small-star: every node b points to its smaller neighbours a
        least = stage(large.groupBy("b").agg(F.min("a").alias("m")), "least")
        small = (large.join(least, "b").select(F.explode(F.array(
            F.struct(F.col("m").alias("a"), F.col("b").alias("b")),
            F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e"))
            .select("e.a", "e.b").where("a < b").distinct())
        small = stage(small, "small")
        unstage(edges, large, least)
        edges = small
        now = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")),
                        F.sum(F.xxhash64("a", "b") % 1000003)).first()
        if now == mark:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")) \
                .union(edges.select(F.col("a"), F.col("a")).distinct())
        mark = now
    raise RuntimeError(f"components not settled after {rounds} rounds")
