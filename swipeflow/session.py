"""Session helpers: a local session for tests/bench and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job here relies on.  The UI stays off: no server is opened.
BASE_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # HotSpot does not JIT methods over 8000 bytes of bytecode; whole-stage
    # code above that would run interpreted, so such subtrees fall back to
    # per-operator codegen instead (the value Spark documents for HotSpot)
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "swipeflow",
                  event_log_dir: str | None = None) -> SparkSession:
    """A local session for tests and the bench (a cluster brings its own)."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in BASE_CONF.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.driver.memory", os.environ.get("SWIPEFLOW_DRIVER_MEMORY", "8g"))
    if event_log_dir:
        b = b.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", event_log_dir)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and staged tables.

    On a cluster ``spark.checkpoint.dir`` names a shared file system and is
    used as is; unset there, this raises, as nodes would not see each other's
    files.  Only a local run (one process) takes a fresh local folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
        path = tempfile.mkdtemp(prefix="swipeflow-ckpt-")  # local runs only
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


_made: list[str] = []


def work_path(spark: SparkSession, name: str) -> str:
    """A new, unique folder under the shared checkpoint folder."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    _made.append(f"{root}/{name}-{uuid.uuid4().hex[:12]}")
    return _made[-1]


def remove_path(spark: SparkSession, path: str | None) -> None:
    """Delete a folder this library created, if present."""
    if path:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clear_work(spark: SparkSession) -> None:
    """Delete every work folder this process made.  Call it when no DataFrame
    that reads them is needed any more."""
    while _made:
        remove_path(spark, _made.pop())


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read it from there:
    column pruning and statistics stay, and an executor loss costs nothing.
    Use where several branches of a plan would recompute ``df``."""
    path = work_path(df.sparkSession, "once")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_by(df: DataFrame, *columns: str) -> DataFrame:
    """``materialize`` in buckets of ``columns`` (as many as shuffle partitions): groups and joins on
    them need no exchange, whatever columns each branch reads."""
    spark = df.sparkSession
    name, path = f"by_{uuid.uuid4().hex}", work_path(spark, "buckets")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(buckets, *columns).sortBy(*columns).option("path", path).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")     # the name only: the files have their own path, and the plan knows the buckets
    return out
