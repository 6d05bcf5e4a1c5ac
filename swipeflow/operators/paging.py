"""Pages of a large result from a stored order.

The rows are put in ranges of the order once, each range a folder, each row with
its position in it; the ranges' counts are stored beside them.  A page is then
found by the counts (one number per range) and read from the one or few folders
that hold it, by position: no page sorts or skips the rows before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE, AT = "_range", "_at"


def build_page_index(df: DataFrame, order: list[str], path: str) -> str:
    """Write ``df`` in ranges of ``order`` (which must be unique for pages to be
    the same each time) to ``path``; returns ``path``."""
    path = path.rstrip("/")
    # the id's lower 33 bits count the rows of a task, which are sorted by then
    ids = F.monotonically_increasing_id()
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(AT, ids)
    rows = rows.withColumn(PAGE, F.shiftright(AT, 33).cast("int")).withColumn(AT, F.col(AT).bitwiseAND((1 << 33) - 1))
    rows.sortWithinPartitions(PAGE, AT).write.mode("overwrite").partitionBy(PAGE).parquet(f"{path}/rows")
    kind = T.StructType([T.StructField(PAGE, T.IntegerType()), T.StructField(AT, T.LongType())])
    df.sparkSession.read.schema(kind).parquet(f"{path}/rows").groupBy(PAGE).count() \
        .write.mode("overwrite").parquet(f"{path}/counts")
    return path


def count_rows(spark: SparkSession, path: str) -> int:
    return spark.read.schema("count long").parquet(f"{path}/counts").agg(F.sum("count")).first()[0] or 0


def read_page(spark: SparkSession, path: str, offset: int, limit: int, schema: T.StructType) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of the order, in order.  Past the
    end there are none."""
    if offset < 0 or limit < 0:
        raise ValueError("offset and limit must not be negative")
    path, first, wanted = path.rstrip("/"), 0, []
    counts = spark.read.schema(f"{PAGE} int, count long").parquet(f"{path}/counts").orderBy(PAGE)
    for r in counts.collect():            # one row per range
        low, high = max(offset - first, 0), min(offset + limit - first, r["count"])
        if low < high:
            wanted.append((r[PAGE], low, high))
        first += r["count"]
    if not wanted:
        return spark.createDataFrame([], schema)
    stored = T.StructType([*schema.fields, T.StructField(AT, T.LongType()), T.StructField(PAGE, T.IntegerType())])
    rows = spark.read.schema(stored).option("basePath", f"{path}/rows").parquet(*[f"{path}/rows/{PAGE}={p}" for p, _, _ in wanted])
    ends = {wanted[0], wanted[-1]}        # ranges in between are whole
    for p, low, high in ends:
        rows = rows.where((F.col(PAGE) != p) | F.col(AT).between(low, high - 1))
    return rows.orderBy(PAGE, AT).select(*[f"`{f.name}`" for f in schema.fields])
