"""A key-value cache with expiry as a table of writes: (key, value, written_at, ttl_seconds).

Values are strings; typed reads cast them and give null for what does not parse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "key string, value string, written_at timestamp, ttl_seconds long"
TYPES = {"string": "string", "int": "int", "int32": "int", "int64": "bigint", "uint": "decimal(20,0)", "uint32": "bigint", "uint64": "decimal(20,0)", "bytes": "binary"}


def _live(now: Column) -> Column:
    return F.col("ttl_seconds").isNull() | (F.unix_timestamp("written_at") + F.col("ttl_seconds") > F.unix_timestamp(now))


def latest(writes: DataFrame) -> DataFrame:
    """The last write of each key; ties by value."""
    last = writes.where("key IS NOT NULL").groupBy("key").agg(F.max(F.struct("written_at", "value", "ttl_seconds")).alias("w"))
    return last.select("key", "w.value", "w.written_at", "w.ttl_seconds")


def get(writes: DataFrame, keys: DataFrame, now: Column, as_type: str = "string") -> DataFrame:
    """(key, value) of each distinct asked key: null if absent, deleted or expired."""
    live = latest(writes).where(_live(now) & F.col("value").isNotNull())
    value = F.encode("value", "UTF-8") if as_type == "bytes" else F.expr(f"try_cast(value AS {TYPES[as_type]})")
    return keys.select("key").distinct().join(live.withColumn("value", value).select("key", "value"), "key", "left")


def exists(writes: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    return get(writes, keys, now).select("key", F.col("value").isNotNull().alias("present"))


def put(writes: DataFrame, rows: DataFrame, now: Column, ttl_seconds: int | None = None) -> DataFrame:
    return writes.unionByName(rows.select("key", F.col("value").cast("string").alias("value"), now.alias("written_at"), F.lit(ttl_seconds).cast("long").alias("ttl_seconds")))


def delete(writes: DataFrame, keys: DataFrame) -> DataFrame:
    return writes.join(keys.select("key").distinct(), "key", "left_anti")


def expire(writes: DataFrame, keys: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """Give the current values of ``keys`` a new lifetime from ``now``."""
    again = latest(writes).join(keys.select("key").distinct(), "key", "left_semi").select("key", "value", now.alias("written_at"), F.lit(ttl_seconds).cast("long").alias("ttl_seconds"))
    return delete(writes, keys).unionByName(again)
