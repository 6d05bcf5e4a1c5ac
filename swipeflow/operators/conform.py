"""Bronze -> silver: fixed types and one row per (employee, swipe)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import digits_only
from ..schemas import SILVER_KEYS, SILVER_SCHEMA
from .upsert import dedup_by


def silver_cast(bronze: DataFrame) -> DataFrame:
    """The 24 silver columns with their declared types.

    ``try_cast`` turns a bad value into NULL instead of failing a 100 TB job
    on one cell.  ``Access_Card`` keeps digits only.  ``Swipe_Date`` becomes
    text (it is part of the key); ``time`` stays ``HH:mm:ss`` text.
    """
    cols = []
    for f in SILVER_SCHEMA.fields:
        c = F.col(f.name)
        if f.name == "Access_Card":
            e = digits_only(c.cast("string"))
        elif f.name == "Swipe_Date":
            e = c.cast("string")
        else:
            e = c.try_cast(f.dataType)
        cols.append(e.alias(f.name))
    return bronze.select(*cols)


def dedup_latest(df: DataFrame, keys: list[str] = SILVER_KEYS, latest: str = "Received_On") -> DataFrame:
    """Keep the most recently received row per key.

    The row is its own order: ``max`` of one struct that begins with the
    received time.  It is an aggregate, so Spark reduces each key map-side
    before the shuffle and a key re-sent a billion times never reaches one task
    as a billion rows.
    """
    return dedup_by(df, keys, latest)


def conform_silver(bronze: DataFrame, start=None, end=None) -> DataFrame:
    """Silver rows from bronze, optionally for a calendar date range."""
    b = bronze
    if start is not None:
        b = b.where(F.col("Date") >= F.lit(start).cast("date"))
    if end is not None:
        b = b.where(F.col("Date") <= F.lit(end).cast("date"))
    return dedup_latest(silver_cast(b))
